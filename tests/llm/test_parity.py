import os
import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from loomtrace.llm.parity import Scheme, distance, near_duplicates, shingles, size_class, sketch

SCHEMA = "doc_id long, text string"


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = bytes(t or "", "utf8").lower().split()
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return {(i, len(sets[i]), top(i)) for i in ids}


def corpus(seed, size, words):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(words)]
    shared = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(size):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 6])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(int(2 ** rng.uniform(0, 8)))]
            if kind > 0.8:
                w = w[: len(w) // 2] + shared + w[len(w) // 2 :]
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


def test_equals_brute_force(spark):
    rows = [*corpus(1, 260, 400), (0, ""), (2, None), (5, "A b"), (8, "a  B\n"), (11, "b a")]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_other_similarity_and_hot_groups(spark):
    rng = random.Random(3)
    base = [f"x{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"y{i % 40}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in corpus(5, 60, 50)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(7)).withColumn("label", F.lit("z"))
    got = {tuple(r) for r in near_duplicates(df, 5, 80, 100).collect()}
    assert got == brute(rows, 5, 80, 100)


def test_empty_null_ids_and_repeats(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, "A b c d e")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (3, 2, 1), (None, 2, None)]


def test_linked_sets_share_a_key():
    scheme = Scheme(85, 100)
    rng = np.random.default_rng(0)
    for n in [7, 8, 13, 20, 40, 90, 200, 700]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            keep = a[rng.permutation(len(a))[: int(np.ceil(len(a) * 0.93))]]
            b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, n // 30).astype(np.uint64)]))
            same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            assert distance(sketch(a), sketch(b)) <= union - same
            if 100 * same >= 85 * union and not np.array_equal(a, b):
                assert len(np.intersect1d(scheme.keys(a), scheme.keys(b)))


def test_shingles():
    assert len(shingles(b"", 4)) == 0 and len(shingles(b" \t", 4)) == 0
    assert np.array_equal(shingles(b"A b", 4), shingles(b"a\nB", 4)) and len(shingles(b"a b a b a b", 4)) == 2
    assert not np.array_equal(shingles("É".encode(), 4), shingles("é".encode(), 4))


def test_pipeline_does_not_depend_on_batch_borders(spark, monkeypatch):
    """Jobs after the first staged table see larger batches, as they do when executors change."""
    import corpus_pipeline
    from loomtrace.llm import parity

    rows = [(i, " ".join([*(f"x{k}" for k in range(200)), f"y{i}"])) for i in range(60)]
    whole = brute(rows, 5, 80, 100)
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, plain = spark.conf.get(size), parity.stage

    def small_then_large(df, name):
        out = plain(df, name)
        spark.conf.set(size, "10000")
        return out

    monkeypatch.setattr(parity, "stage", small_then_large)
    try:
        spark.conf.set(size, "4")
        kept = {r.doc_id for r in corpus_pipeline.jaccard_join(spark, docs, "").collect()}
    finally:
        spark.conf.set(size, before)
    assert kept == {top for _, _, top in whole}


def test_repeated_ids_with_other_texts(spark):
    import corpus_pipeline

    words = [chr(97 + k) * 3 for k in range(26)]
    other = "quite another text with words of its own that nothing else here has at all as far as one can see in it"
    rows = [(1, " ".join(words)), (2, " ".join([*words, "zz"])), (2, other), (3, other + " at"), (2, other)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    n = len(other.split()) - 3
    assert got == sorted([(1, 23, 1), (2, 24, 1), (2, n, 2), (2, n, 2), (3, n + 1, 2)])
    kept = sorted((r.doc_id, r.text, r.source) for r in corpus_pipeline.jaccard_join(spark, df.withColumn("source", F.lit("s")), "").collect())
    assert kept == [(1, " ".join(words), "s"), (2, other, "s")]


def chained(seed, groups, size, length=60):
    """Groups of texts that share most words but drift apart, so that links form chains and components."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(length)] = f"v{rng.randrange(9)}"
            if rng.random() < 0.4:
                base = w
            rows.append((len(rows), " ".join(w[: length - rng.randint(0, 5)])))
    return rows


def test_hot_keys_cells_and_flushes(spark, monkeypatch):
    """Everything is hot, cells are tiny, and lots and runs end often: components are whole all the same."""
    from loomtrace.llm import parity

    rows = [*chained(1, 2, 70), *[(1000 + i, t) for i, t in corpus(9, 60, 60)]]
    want = brute(rows, 4, 85, 100)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert {tuple(r) for r in near_duplicates(df).collect()} == want

    monkeypatch.setattr(parity, "NARROW", 1)
    monkeypatch.setattr(parity, "_LOT", 3000)
    whole = parity.linked_groups(df, block=6).select("doc_id", "n_shingles", "component_id")
    assert {tuple(r) for r in whole.collect()} == want


def test_long_text_in_pieces(monkeypatch):
    from loomtrace.llm import parity

    text = b" ".join(b"w%d" % (k * k % 97) for k in range(5000)) + b"\xc2\xa0x\x0b y"
    whole = shingles(text, 4)
    monkeypatch.setattr(parity, "_PIECE", 100)
    assert np.array_equal(shingles(text, 4), whole)


def test_hot_runs_over_batches():
    """A key whose run is longer than what is held keeps its star connected, and every member is named once or more."""
    import pyarrow as pa

    from loomtrace.llm import parity

    scheme = Scheme(85, 100)
    ids = np.unique((np.random.default_rng(1).integers(0, 1 << 62, 30_000) & ~np.int64(1023)) | 120)
    key = np.full(len(ids), 5 << 8)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 3000]), pa.array(ids[k : k + 3000]), pa.array(np.zeros(len(ids[k : k + 3000]), np.int32)), pa.nulls(len(ids[k : k + 3000]), pa.binary())], parity._ROW) for k in range(0, len(ids), 3000)]
    out = pa.Table.from_batches(list(parity._join_runs(scheme)(iter(batches))))
    member, centre = np.asarray(out["b"]), np.asarray(out["c"])
    assert set(member.tolist()) == set(ids.tolist())
    up = dict(zip(member.tolist(), centre.tolist()))
    tops = set()
    for x in member.tolist():
        while up[x] != x:
            x = up[x]
        tops.add(x)
    assert len(tops) == 1


def test_agreements_of_linked_sets_follow_their_sizes():
    """Linked sets agree in as many keys as their own sizes ask for, and sets that are small in their scheme are asked for more than slack and one."""
    rng, more = np.random.default_rng(4), 0
    for num, den in ((85, 100), (80, 100)):
        scheme = Scheme(num, den)
        for n in [3, 9, *rng.integers(20, 700, 60).tolist()]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            new = int((den - num) * len(a) / (den + num))
            b = np.unique(np.concatenate([a[new:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            assert den * same >= num * (len(a) + len(b) - same)
            own = {}
            for x in (a, b):
                keys, slacks = scheme.keyed(x)
                for k, (kind, s) in zip(keys, slacks):
                    own.setdefault(kind, []).append((set(k.tolist()), s))
            ids = [np.array([size_class(len(x))], np.int64) for x in (a, b)]
            kind = 2 * int(scheme.band[ids[0][0]]) if scheme.band[ids[0][0]] == scheme.band[ids[1][0]] else 2 * min(int(scheme.band[i[0]]) for i in ids) + 1
            if kind not in own:
                continue
            (ka, sa), (kb, sb) = own[kind]
            extra = int(scheme.surplus(np.array([kind]), *ids)[0])
            more = max(more, extra)
            assert len(ka & kb) >= 1 + max(sa, sb) + extra or np.array_equal(a, b)
    assert more > 10


def test_staged_tables_leave_no_shuffle_files(tmp_path):
    """In a session of its own: its folder holds no shuffle file once a table is staged."""
    code = """
import os, sys
from pyspark.sql import SparkSession, functions as F
sys.path.insert(0, sys.argv[2])
from loomtrace.llm.common import stage
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).config("spark.checkpoint.dir", sys.argv[1] + "/cp").getOrCreate()
found = stage(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count(), "x")
print("files", sum(f.startswith("shuffle_") for _, _, names in os.walk(sys.argv[1]) for f in names), found.count())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path), root], capture_output=True, text=True, timeout=120).stdout
    assert "files 0 100" in out


def test_unlike_sets_share_no_key():
    """Words of one or two elements were alike by chance, so pairs and hot keys grew with the square of the input."""
    rng = np.random.default_rng(1)
    for scheme in (Scheme(85, 100), Scheme(80, 100)):
        keys = [scheme.keys(np.unique(rng.integers(0, 1 << 63, 150).astype(np.uint64))) for _ in range(400)]
        assert len(np.unique(np.concatenate(keys))) == sum(len(k) for k in keys)


def test_candidates_of_cells_go_as_pairs(spark, monkeypatch):
    """Sets that meet under many hot keys are compared once; before, their whole sets went to each of the cells. Cells with very many candidates still take whole sets."""
    from loomtrace.llm import parity

    rows = [(k, t) for k, (_, t) in enumerate(chained(7, 3, 40))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 4, 85, 100)
    names, plain = [], parity.stage

    def named(df, name):
        out = plain(df, name)
        names.append((name, out.count() if name in ("cells", "found", "few") else 0))
        return out

    monkeypatch.setattr(parity, "stage", named)
    assert {tuple(r) for r in near_duplicates(df).collect()} == want
    assert "cells" in dict(names) and dict(names)["few"] and "found" not in dict(names)
    names.clear()
    monkeypatch.setattr(parity, "_PAIRS", 0)
    assert {tuple(r) for r in near_duplicates(df).collect()} == want
    assert "found" in dict(names) and not dict(names)["few"]


def test_rows_that_surely_stay_are_not_looked_up(spark):
    from loomtrace.llm.parity import parted

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(spark.createDataFrame([(None, "n")], SCHEMA))
    sure, others = (sorted(r.doc_id for r in x.collect()) for x in parted(rows, spark.range(0, 5000, 50)))
    assert sorted(sure + others) == list(range(5000)) and set(range(0, 5000, 50)) <= set(others) and len(others) < 200
