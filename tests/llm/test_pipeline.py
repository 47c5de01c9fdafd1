"""The pipeline stage by stage on a small table, each stage against what it should do there."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = {"aa": "the house with thing shore whether garden under river stone".split(), "bb": "que niño señal año corazón mujer camino fuego tierra cielo".split()}
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


def text(rng, lang, n=80):
    return " ".join(rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = [(i, text(rng, lang), lang, "s1") for i, lang in enumerate(["aa", "bb"] * 20)]
    base = text(rng, "aa").split()
    near = [*base[:40], "changed", *base[41:]]
    rows += [(100, " ".join(base), "aa", "s"), (101, " ".join(base), "aa", "s"), (102, " ".join(near), "aa", "s"), (100, " ".join(base), "aa", "s")]
    rows += [(200, text(rng, "aa", 60) + " " + ITEM + " " + text(rng, "aa", 60), "aa", "s"), (300, text(rng, "bb", 60) + " jo.doe@mail.example.com or +1 (988) 555-2485", "bb", "s")]
    rows += [(400, None, "aa", "s"), (401, "", None, "s"), (402, "12 34 !", None, None), (403, "the", None, "s"), (None, text(rng, "bb"), "bb", "s"), (500, text(rng, "aa", 30_000), None, "s")]
    at = tmp_path_factory.mktemp("docs")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.withColumns({"key": F.lit(1), "sketch": F.lit("x"), "n": F.lit(2.5)}).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), rows


def test_stages(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, at), name)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted((r.doc_id for r in docs.collect()), key=str))
    ids = sorted((r[0] for r in rows), key=str)
    first = [i for i in ids if i not in (400, 401, 402)]
    second = [i for i in first if i not in (101, 102)]
    second.remove(100)
    assert kept[0] == first and kept[1] == second and kept[2] == [i for i in second if i != 200] == kept[3]
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert clean[300].endswith("<email> or <phone>") and all(clean[r[0]] == r[1] for r in rows if r[0] in clean and r[0] != 300)
    packed = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id for r in packed} == set(clean)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert max(sum(x) for x in by.values()) <= 2048 and sum(r.doc_id == 500 for r in packed) == -(-max(r.start + r.length for r in packed if r.doc_id == 500) // 2048)
    assert re.search("email", clean[300])


def test_empty_table(spark, folder, tmp_path):
    at, _ = folder
    spark.read.parquet(f"{at}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_forget_the_words_of_other_operators():
    """A worker serves one operator after another; before, it kept the words of all of them."""
    import pyarrow as pa

    from loomtrace.llm import common, parity

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"some words of a text", b"others"]), pa.array([5, 6])], ["doc_id", "text", "text_hash"])
    assert list(parity._describe(5, parity.Scheme(80, 100))([batch])) and parity._HASHES
    common.WordMemo.at(common.tokenizer_path())
    assert common._MEMOS and not parity._HASHES
    list(parity._join_runs(parity.Scheme(80, 100))([]))
    assert not common._MEMOS
    assert [b.num_rows for b in common.portions([batch, batch.slice(0, 0)], 1)] == [1, 1]


def test_packing_of_the_pipeline_remembers_fewer_words(folder, monkeypatch):
    """What earlier stages took stays with the executors, so the last one's memo is a third of what it is alone."""
    from loomtrace.llm import common

    asked = {}
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, **given: asked.update(given))
    corpus_pipeline.best_fit_packing(None, None, folder[0])
    assert asked["words"] <= 300_000
    path = common.tokenizer_path()
    memo, text = common.WordMemo.at(path, 50), " ".join(f"word{k}" for k in range(400))
    assert [memo.encode(t) for t in (text, "word1 word2", text)] == [memo.direct(t) for t in (text, "word1 word2", text)] and memo.most == 50
    assert common.WordMemo.at(path).most == 900_000


def test_tables_between_steps_go(spark, folder, tmp_path):
    """What the Jaccard join staged on its way, and the table of the stage before, were left until the end; texts of rows that stay were shuffled."""
    import os

    from loomtrace.llm import common

    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    place = f"{common.shared_dir(spark).removeprefix('file:').replace('//', '/')}/loomtrace"
    held = lambda: {x.split("-", 1)[1] for x in os.listdir(place)}
    common.clear_staged(spark)
    joined = corpus_pipeline.jaccard_join(spark, docs, at)
    assert held() == {"kept"} and joined.count()
    common.clear_staged(spark)
    corpus_pipeline.run(spark, at)
    assert "pii" in held() and not held() & {"met", "nodes", "language_id", "jaccard_join", "decontamination"}
