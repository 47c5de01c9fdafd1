"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, remember, split_words

_EDGES = b".,;:!?\"'()[]"


def _hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words without punctuation at their edges."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.strip(_EDGES) or w) for w in words), np.uint64, len(words))


def word_hashes(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words (ASCII lower case, split at ASCII white space, edge punctuation off) and their 64-bit hashes."""
    words = text.lower().split()
    return [w.strip(_EDGES) or w for w in words], _hashed(words)


def text_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has; each distinct word is hashed once."""
    words, number, sizes = split_words(column)
    return _hashed(words)[number], sizes


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of ``n`` words."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def align(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> tuple[int, int, int]:
    """Smith-Waterman score of word sequences, and the first and last aligned word of ``b``.

    Row by row: a gap along the row is a running maximum, so each row is a few
    array operations.
    """
    m = len(b)
    step = gap * np.arange(m + 1)
    h, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, where = 0, (0, 0)
    for x in a:
        s = np.where(b == x, match, -miss)
        diag, up = h[:-1] + s, h[1:] - gap
        v = np.zeros(m + 1, np.int64)
        v[1:] = np.maximum(np.maximum(diag, up), 0)
        begin = np.arange(m + 1)
        begin[1:] = np.where(v[1:] == 0, begin[1:], np.where(diag >= up, start[:-1], start[1:]))
        run = np.maximum.accumulate(v + step)
        source = np.maximum.accumulate(np.where(v + step == run, np.arange(m + 1), 0))
        h = run - step
        start = np.where(h > 0, begin[source], np.arange(m + 1))
        j = int(h.argmax())
        if h[j] > best:
            best, where = int(h[j]), (int(start[j]), j)
    return best, where[0], where[1] - 1


class Seeds:
    """The n-grams of at most some thousands of test items, for lookup in passages."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.items = n, []
        at: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, (item, text) in enumerate(items):
            words, h = word_hashes(text.encode())
            self.items.append((item, h))
            size = min(n, len(h))
            if not size:
                continue
            into = at if size == n else self.short.setdefault(size, {})
            for pos, g in enumerate(gram_hashes(h, size).tolist()):
                into.setdefault(g, []).append((k, pos))
        self.tables = [(size, np.array(sorted(t), np.uint64), t) for size, t in [(n, at), *self.short.items()] if t]
        #: Of each table, which leading 20 bits its seeds have: most n-grams of a text need no search among the seeds.
        self.leading = []
        for _, keys, _ in self.tables:
            self.leading.append(np.zeros(1 << 20, bool))
            self.leading[-1][keys >> np.uint64(44)] = True

    def hits(self, h: np.ndarray, sizes: np.ndarray) -> dict[int, list]:
        """(seed, word number, table) wherever texts have a seed, by text; ``h`` holds the words of all texts, ``sizes`` of them each."""
        out: dict[int, list] = {}
        first = np.cumsum(sizes) - sizes
        for (size, keys, table), leading in zip(self.tables, self.leading):
            g = gram_hashes(h, size)
            at = np.flatnonzero(leading[g >> np.uint64(44)])
            low = np.searchsorted(keys, g[at])
            low[low == len(keys)] = 0
            at = at[keys[low] == g[at]]
            own = np.searchsorted(first, at, "right") - 1
            inside = at - first[own] + size <= sizes[own]  # no n-gram crosses texts
            at, own = at[inside], own[inside]
            for k, seed, pos in zip(own.tolist(), g[at].tolist(), (at - first[own]).tolist()):
                out.setdefault(k, []).append((seed, pos, table))
        return out


def _count(sent):
    def run(batches):
        remember()
        seeds, c = sent.value, Counter()
        for b in portions(batches):
            for found in seeds.hits(*text_hashes(b.column(1))).values():
                c.update({g for g, _, _ in found})
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(c), np.uint64).view(np.int64)), pa.array(list(c.values()), pa.int64())], ["seed", "n"])

    return run


class Search:
    """Finds the items that texts hold; alignments of the same passage are remembered."""

    def __init__(self, seeds: Seeds, rare: list[set[int]], least: float):
        self.seeds, self.rare, self.least = seeds, rare, least
        self.known: dict[tuple[int, bytes], tuple] = {}

    def __call__(self, column) -> dict[int, list[tuple[int, float, int, int]]]:
        """(item_id, score, first word, last word) of each item held, by text, of those that hold any."""
        h, sizes = text_hashes(column)
        first = np.cumsum(sizes) - sizes
        hits = self.seeds.hits(h, sizes)
        found = {k: self._held(h[first[k] : first[k] + sizes[k]], hits[k]) for k in sorted(hits)}
        return {k: x for k, x in found.items() if x}

    def _held(self, h: np.ndarray, hits: list) -> list[tuple[int, float, int, int]]:
        spots: dict[int, dict[int, set[int]]] = {}
        for g, pos, table in hits:
            for k, at in table[g]:
                span = max(8, len(self.seeds.items[k][1]) // 2)
                found = spots.setdefault(k, {}).setdefault(max(0, pos - at) // span, set())
                found.add(-1 if g in self.rare[k] else g)
        out = []
        for k, found in spots.items():
            item, target = self.seeds.items[k]
            size, best = len(target), (0, 0, 0)
            span = max(8, size // 2)
            for w in sorted(found):
                # a rare seed, or two others at about one place of the text, here or over the border to the next window
                near = found[w] | found.get(w + 1, set())
                if -1 not in found[w] and len(near) < 2:
                    continue
                lo = max(0, (w - 1) * span - 4)
                part = h[lo : (w + 1) * span + size + size // 3 + 4]
                key = (k, part.tobytes())
                if key not in self.known:
                    if len(self.known) > 50_000:
                        self.known.clear()
                    self.known[key] = align(target, part)
                score, first, last = self.known[key]
                if score > best[0]:
                    best = (score, lo + first, lo + last)
            if best[0] >= self.least * 2 * size:
                out.append((item, best[0] / (2 * size), best[1], best[2]))
        return out


def _find(sent):
    def run(batches):
        remember()
        search = Search(*sent.value)
        for b in portions(batches):
            ids = b.column(0)
            rows = [(ids[k].as_py(), *hit) for k, held in search(b.column(1)).items() for hit in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def _searches(rows: DataFrame, benchmark: DataFrame, n: int, least: float, lot: int, item_col: str, item_text: str):
    """For each lot of items, its broadcast seeds, rare seeds and threshold; ``rows`` are (doc_id, text binary)."""
    spark = rows.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null")
    lots = max(1, -(-items.count() // (lot // 2)))
    for k in range(lots):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == k) if lots > 1 else items
        seeds = Seeds(sorted({(r.item_id, r.text) for r in own.collect()}, key=str), n)
        counted = rows.mapInArrow(_count(spark.sparkContext.broadcast(seeds)), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        df = {r.seed & (1 << 64) - 1: r.n for r in counted.collect()}
        yield spark.sparkContext.broadcast((seeds, [_rare(h, n, df) for _, h in seeds.items], least))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, lot: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; see ``contaminated``."""

    def keep(sent):
        def run(batches):
            remember()
            search = Search(*sent.value)
            for b in portions(batches):
                keep = np.ones(b.num_rows, bool)
                keep[list(search(b.column(text_col)))] = False
                yield b.filter(pa.array(keep))

        return run

    out = docs
    for sent in list(_searches(_rows(docs, id_col, text_col), benchmark, n, least, lot, item_col, item_text)):
        out = out.mapInArrow(keep(sent), docs.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, lot: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of every document that holds an item.

    Items are taken in lots of at most ``lot``, which bounds what is broadcast at
    any size of the benchmark; each lot scans the corpus twice. The first scan
    counts in how many documents each of the items' n-grams occurs; an item's rare
    seeds are those no more frequent than its median seed. In the second, passages
    with a rare seed, or with two others at about one place, are aligned with the
    item; score is the alignment's share of a perfect one, and at least ``least`` is
    a copy, edited or whole. Copies so broken that they share no such seeds are
    lost; a test measures how few. All narrow: rows of a passage that very many
    documents hold stay where they are.

    Null texts and items hold nothing; items without words match nothing; items
    of fewer than ``n`` words are sought as a whole; repeated documents are
    reported each; null ids stay null.
    """
    rows = _rows(docs, id_col, text_col)
    parts = [rows.mapInArrow(_find(sent), "doc_id long, item_id long, score double, first_word long, last_word long") for sent in _searches(rows, benchmark, n, least, lot, item_col, item_text)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rare(h: np.ndarray, n: int, df: dict[int, int]) -> set[int]:
    own = list(dict.fromkeys(gram_hashes(h, min(n, len(h))).tolist())) if len(h) else []
    if not own:
        return set()
    middle = sorted(df.get(g, 0) for g in own)[(len(own) - 1) // 2]
    return {g for g in own if df.get(g, 0) <= middle}
