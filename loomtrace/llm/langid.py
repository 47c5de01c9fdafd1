"""Language proportions of documents by mixture inference over letter n-grams."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, remember

BUCKETS = 1 << 14


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of the whole text, spaces at word ends included: buckets and counts."""
    code = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4")]
    if len(code) < 3 or not code.any():
        return np.zeros(0, np.int64), np.zeros(0)
    h = (code[:-2] * np.uint32(0x9E3779B1) ^ code[1:-1] * np.uint32(0x85EBCA77) ^ code[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    h = (h >> np.uint32(18))[code[1:-1] > 0]
    count = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text (null: empty) modulo ``mod``."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def train(docs: DataFrame, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities from all rows of (text, lang).

    Each task sends one count for each language and bucket it has seen; sums are
    pre-aggregated. Every language is learned: what comes to the driver, and is
    broadcast, is 64 KB for each value of ``lang``, whatever the rows.
    """

    def count(batches):
        remember()
        held: dict[str, np.ndarray] = {}
        for b in portions(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = grams(text)
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS)
                held[lang][at] += n
                if len(held) > 64:
                    yield from out(held)
                    held = {}
        yield from out(held)

    def out(held):
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    table = np.zeros((BUCKETS, len(langs)), np.float32)
    if len(langs):
        table[np.asarray(found.column("bucket")), place[np.asarray(names.indices)]] = np.asarray(found.column("n"))
    return langs, ((table + smooth) / (table.sum(axis=0, dtype=np.float64) + smooth * BUCKETS)).astype(np.float32)


def _em(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of a mixture with components ``p``."""
    w, total, last = np.full(p.shape[1], 1 / p.shape[1]), n.sum(), -np.inf
    for _ in range(rounds):
        mix = p @ w
        like = float(n @ np.log(mix))
        if like - last < 1e-3:
            break
        last = like
        w = w * (p.T @ (n / mix)) / total
    return w, float(n @ np.log(p @ w))


def proportions(at: np.ndarray, n: np.ndarray, table: np.ndarray, rounds: int = 25, price: float = 5.0) -> np.ndarray:
    """Each language's share of a document.

    EM over all languages; those that are left with less than one trigram go, then
    the weakest one is dropped again and again while the log likelihood, less
    ``price`` * log(n) for each language, does not fall. The price is high because
    overlapping trigrams are not independent.
    """
    p = table[at].astype(np.float64)
    kept = np.arange(p.shape[1])
    penalty = price * np.log(n.sum() + 1)
    w, like = _em(p, n, rounds)
    some = w * n.sum() >= 1
    if 0 < some.sum() < len(kept):
        kept = kept[some]
        w, like = _em(p[:, kept], n, rounds)
    while len(kept) > 1:
        rest = np.delete(np.arange(len(kept)), w.argmin())
        if len(rest) == 1:
            w2, like2 = np.ones(1), float(n @ np.log(p[:, kept[rest[0]]]))
        else:
            w2, like2 = _em(p[:, kept[rest]], n, rounds)
        if like2 + penalty < like:
            break
        kept, w, like = kept[rest], w2, like2
    out = np.zeros(p.shape[1])
    out[kept] = w
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture) of every row; mixture is ``lang:share`` by falling share.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Whole texts; the model, languages times 16,384 doubles, is broadcast.
    """
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        remember()
        for b in portions(batches):
            pred, score, mix = [], [], []
            for text in b.column(1).to_pylist():
                at, n = grams(text) if text and langs else ((), ())
                if not len(at):
                    pred.append("und"), score.append(0.0), mix.append("")
                    continue
                w = proportions(at, n, sent.value)
                order = [i for i in np.argsort(-w, kind="stable").tolist() if w[i] > 0]
                pred.append(langs[order[0]])
                score.append(min(1.0, float(w[order[0]])))
                mix.append(",".join(f"{langs[i]}:{w[i]:.3f}" for i in order))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], ["doc_id", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")


def language_id(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict every row.

    Repeated rows are each learned from and predicted; rows with null lang or
    text teach nothing; an empty table gives no rows.
    """
    fold = remainder(F.col("doc_id"), folds)
    model = train(docs.where(fold != held))
    found = predict(docs, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "mixture")


def drop_unknown(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", most_noise: float = 0.75) -> DataFrame:
    """The rows of ``docs`` in the learned languages, with all their columns.

    Beside the languages the mixture holds noise, in which all trigrams are as
    likely. A text goes if it is null, has no letter, or more than ``most_noise`` of
    its trigrams are noise; all go if no language was learned.
    """
    langs, table = model
    noisy = np.concatenate([table, np.full((BUCKETS, 1), 1 / BUCKETS, table.dtype)], axis=1)
    sent = docs.sparkSession.sparkContext.broadcast(noisy)

    def run(batches):
        remember()
        for b in portions(batches):
            keep = []
            for text in b.column(text_col).to_pylist():
                at, n = grams(text) if text and langs else ((), ())
                keep.append(bool(len(at)) and float(proportions(at, n, sent.value)[-1]) <= most_noise)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
