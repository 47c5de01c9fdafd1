import math

import numpy as np
from pyspark.sql import functions as F

from loomtrace.llm.decontaminate import align, contaminated, drop_contaminated
from loomtrace.llm.topk import exact_topk, search_blocks

VEC = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: (i, v) for i, v in ok if i % every == 0}.values():
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
        out |= {(q, r + 1, i, -t) for r, (t, i) in enumerate(s)}
    return out


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (310, [1.0, 2.0]), (320, [0.5, 0.5]), (330, []), (331, []), (None, [0.0] * 6), (40, rows[40][1])]
    df = spark.createDataFrame(rows, VEC).withColumn("rank", F.lit(1)).repartition(5)
    got = {tuple(r) for r in exact_topk(df, 10, 7, block_rows=16, query_rows=16).collect()}
    assert got == brute(rows, 10, 7)
    assert {tuple(r) for r in exact_topk(df, 10, 7, block_rows=4, query_rows=5, group_bytes=400).collect()} == got
    assert exact_topk(spark.createDataFrame([], VEC)).count() == 0
    assert exact_topk(spark.createDataFrame([(1, [1.0])], VEC)).count() == 0


def test_blocks_are_pruned_without_loss_of_ties():
    one = np.ones((1, 2))
    blocks = [(np.array([5]), one, one[0], one[0]), (np.array([3]), one, one[0], one[0]), (np.array([9]), -one, -one[0], -one[0])]
    n, i, s = search_blocks((np.array([0]), one), blocks, 1)
    assert i.tolist() == [3] and s.tolist() == [2]


def test_values_beyond_the_exact_doubles(spark):
    """Large finite parts: ranked by exact integers, scores shown within the longs; too large to scale takes no part."""
    rows = [(0, [1e17, 3.0]), (1, [2e17, 1.0]), (2, [2e17, 2.0]), (3, [-1e17, 0.0]), (4, [1.0, 1.0]), (5, [1e6, -7.0]), (6, [1e308, 1.0]), (7, [1e300, 0.0]), (10, [2.0**44, 1.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 9).collect()}
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i != 6}
    for q in (0, 10):
        order = sorted(((-sum(x * y for x, y in zip(ok[q], v)), i) for i, v in ok.items() if i != q))
        assert [got[q, r + 1] for r in range(len(order))] == [(i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in order]


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def docs(spark):
    w = ITEM.split()
    edited = " ".join("other" if k in (4, 9, 15) else x for k, x in enumerate(w))
    moved = " ".join(w[:8] + ["and", "so"] + w[8:])
    fill = " ".join(f"f{k}" for k in range(300))
    rows = [(1, f"{fill} {ITEM.upper()}. {fill}"), (2, f"{fill} {edited}"), (3, moved), (4, fill), (5, None), (6, ""), (7, " ".join(w[:4]) + " " + fill), (8, " ".join(reversed(w))), (None, ITEM), (9, "two words"), (9, "two words")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))


BENCH = [(10, ITEM), (11, "two words"), (12, None), (13, ""), (14, "nowhere to be seen at all in here")]


def test_contaminated(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in contaminated(docs(spark), bench).collect())
    assert got == [("1", 10), ("2", 10), ("3", 10), ("9", 11), ("9", 11), ("None", 10)]
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs(spark), bench).collect()) == ["4", "5", "6", "7", "8"]
    small = sorted((str(r.doc_id), r.item_id) for r in contaminated(docs(spark), bench, lot=2).collect())
    assert small == got
    assert contaminated(docs(spark), bench.where("false")).count() == 0 and contaminated(docs(spark).where("false"), bench).count() == 0


def test_align_equals_plain_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert align(a, b)[0] == h.max()
    assert align(np.arange(5), np.array([9, 9, 0, 1, 2, 3, 4, 9])) == (10, 2, 6)


def edited(rng, words, vocab):
    """A part of an item with words replaced, dropped and added, in a text of other words."""
    a = rng.integers(0, max(1, len(words) // 2))
    out = []
    for w in words[a : a + rng.integers(len(words) // 2, len(words) + 1)]:
        kind = rng.random()
        if kind < 0.1:
            out.append(str(rng.choice(vocab)))
        elif kind < 0.15:
            out += [w, str(rng.choice(vocab))]
        elif kind > 0.05 + 0.15:
            out.append(w)
    return out


def test_recall_against_alignment_of_everything(spark):
    """Every text against every item, whole: what scores enough is found in at least nine of ten cases, and nothing else is."""
    from loomtrace.llm.decontaminate import word_hashes

    rng = np.random.default_rng(11)
    vocab = [f"w{k}" for k in range(400)]
    share = 1 / np.arange(1, 401)
    draw = lambda n: [str(x) for x in rng.choice(vocab, n, p=share / share.sum())]
    items = [draw(int(rng.integers(10, 45))) for _ in range(40)]
    texts = []
    for k in range(260):
        w = draw(int(rng.integers(20, 120)))
        if k % 4:
            w += edited(rng, items[k % 40], vocab) + draw(30)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    hashed = [word_hashes(" ".join(w).encode())[1] for w in items]
    want = {(i, k) for i, t in enumerate(texts) for k, h in enumerate(hashed) if align(h, word_hashes(t.encode())[1])[0] >= len(h)}
    assert len(want) > 100 and got <= want and len(got & want) >= 0.9 * len(want), (len(got), len(want))


def test_copy_of_the_commoner_half(spark):
    """Of an item whose first half holds the rarer n-grams only the second half is copied."""
    w = ITEM.split()
    rows = [(k, " ".join(w[9:])) for k in range(5)] + [(9, "x " * 50 + " ".join(w[9:]) + " y" * 50)]
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 9} and all(abs(r.score - 0.55) < 1e-9 for r in got)


def test_each_distinct_word_is_hashed_once(monkeypatch):
    """Hashes of whole lots are those of single texts, null and sliced columns included; seeds are found where single texts have them."""
    import pyarrow as pa
    from loomtrace.llm import decontaminate as d

    texts = ["The (cat) sat, on the mat!", None, "", " \t", "... the cat", "cat sat on", "É\u00a0ü the\x1cmat SAT"] * 40
    digest, asked = d.xxhash.xxh3_64_intdigest, []
    monkeypatch.setattr(d.xxhash, "xxh3_64_intdigest", lambda w: asked.append(w) or digest(w))
    h, sizes = d.text_hashes(pa.array(texts, pa.string()))
    assert len(asked) < 30
    single = [d.word_hashes((t or "").encode())[1] for t in texts]
    assert sizes.tolist() == list(map(len, single)) and h.tolist() == [x for s in single for x in s.tolist()]
    for column in (pa.array(texts, pa.large_string()), pa.array([None if t is None else t.encode() for t in texts], pa.binary()), pa.array(texts, pa.large_string()).cast(pa.large_binary())):
        part, n = d.text_hashes(column.slice(3, 5))
        assert part.tolist() == [x for s in single[3:8] for x in s.tolist()] and n.tolist() == sizes.tolist()[3:8]
    seeds = d.Seeds([(1, "the cat sat on"), (2, "mat")], 3)
    want = {k: x[0] for k, s in enumerate(single) if (x := seeds.hits(s, np.array([len(s)])))}
    assert seeds.hits(h, sizes) == want and {k % 7 for k in want} == {0, 5} | {k % 7 for k, t in enumerate(texts) if b"mat" in (t or "").lower().encode().replace(b"!", b"").split()}
