"""Exact n-gram Jaccard join by parity sketches."""

from __future__ import annotations

from functools import cache
from math import ceil, exp, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import portions, remember, stage
from .components import components

#: A key that more distinct sets have is hot: it gives stars, not all pairs.
NARROW = 8
_SEEDS = 4
_RATIO = 1.5
_STEP = 1.03
_LOT = 300_000  # elements whose keys are held at once
_PIECE = 1 << 20  # bytes of a text that are split at once
_HASHES: dict[bytes, int] = {}
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: bytes) -> np.ndarray:
    """Hashes of the words of a piece of text."""
    words = text.lower().split()
    try:
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_HASHES) > 300_000:
            _HASHES.clear()
        for w in set(words):
            if w not in _HASHES:
                _HASHES[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _pieces(text: bytes):
    """A long text in pieces that end at ASCII white space."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams.

    A-Z are lower-cased; words end at ASCII white space. With fewer words, the
    whole sequence is the only one; without words there is none.
    """
    h = _words(text) if len(text) <= _PIECE else np.concatenate([_words(p) for p in _pieces(text)])
    if not len(h):
        return np.zeros(0, np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):  # a sum of hashes, each with an odd factor for its place
        out *= _MULTIPLIER
        out += h[k : len(h) - size + 1 + k]
    out = _mix(out)
    out.sort()
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def _grid() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * _STEP)))
    return np.array(edges, np.int64)


#: Size classes, some three in a hundred wide; a set's id holds its class in the low ten bits.
GRID = _grid()


def size_class(n) -> np.ndarray:
    return np.searchsorted(GRID, n, "right") - 1


class Scheme:
    """Size bands, and for each band and each border between bands the number of parts.

    Sets A and B with Jaccard similarity of at least num/den differ in at most
    (den - num) / (den + num) * (|A| + |B|) elements. Each of them changes one word
    of a parity sketch, so of D + 1 + h words at least h + 1 are equal,
    D being the most for the sizes that a scheme joins.
    """

    def __init__(self, num: int, den: int):
        if not 2 * den < 3 * num <= 3 * den:
            raise ValueError("the similarity must lie over 2/3 and at most at 1")
        self.num, self.den, self.edges = num, den, [1]
        while self.edges[-1] < GRID[-1]:
            at = np.searchsorted(GRID, max(self.edges[-1] + 1, int(self.edges[-1] * _RATIO)))
            self.edges.append(int(GRID[min(at, len(GRID) - 1)]))
        self.lows = np.array(self.edges)
        self.band = np.searchsorted(self.lows, GRID, "right") - 1
        #: Classes so far apart hold no sets that can be linked.
        self.reach = ceil(log(den / num) / log(_STEP)) + 1
        #: For each scheme, the D of the largest sets that it joins; for each class, its largest size.
        self.widest = np.array([max(0, p - 1 - h) for p, h in map(self.parts, range(2 * len(self.edges) - 2))], np.int64)
        self.top = np.append(GRID[1:] - 1, GRID[-1])

    def most(self, total: int) -> int:
        """The largest symmetric difference of linked sets whose sizes sum to ``total``."""
        return (self.den - self.num) * total // (self.den + self.num)

    @cache
    def parts(self, kind: int) -> tuple[int, int]:
        """Words and words that may be zero, for scheme 2k (inside band k) or 2k + 1 (bands k and k + 1)."""
        k = kind // 2
        high = self.edges[k + 1] - 1
        low = self.edges[k] if kind % 2 == 0 else -(-self.num * self.edges[k + 1] // self.den)
        far = high if kind % 2 == 0 else high * self.den // self.num
        d = self.most(high + far)
        h = 0
        for _ in range(6):
            p = d + 1 + h
            zero = p * exp(-low / p)
            h = int(zero + 3 * sqrt(zero))
        return (d + 1 + h, h) if d else (0, 0)

    def surplus(self, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Agreements that links of sets of these ids need beyond slack and one: a scheme's words are enough for its largest sets, and smaller ones differ in fewer."""
        total = self.top[a & 1023] + self.top[b & 1023]
        return np.maximum(0, self.widest[kind] - (self.den - self.num) * total // (self.den + self.num))

    @cache
    def kinds(self, n: int) -> list[int]:
        """The schemes in which a set of n elements takes part."""
        k = int(np.searchsorted(self.lows, n, "right")) - 1
        out = [2 * k]
        if n * self.den >= self.num * self.edges[k + 1]:
            out.append(2 * k + 1)
        if k and self.num * n <= self.den * (self.edges[k] - 1):
            out.append(2 * k - 1)
        return [x for x in out if self.parts(x)[0]]

    def keyed(self, elements: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
        """For each of the set's schemes, its keys, and (scheme, slack): linked sets agree in more keys than either one's slack.

        The low byte of a key is its scheme. A zero word is common to many sets and
        is no key. Since h + 1 words of linked sets agree, sets with z zeros agree in
        more than h - z others; this is the slack. Only sets with more than h zeros
        are dealt again by the next seed, against each other, and by the last one
        with their zeros; their slack is 0.
        """
        found, slacks = [], []
        for kind in self.kinds(len(elements)):
            p, h = self.parts(kind)
            own, slack = [], 0
            for seed in range(_SEEDS):
                word = _parities(_mix(elements ^ np.uint64(0xA24BAED4963EE407 * (seed + 1) & (1 << 64) - 1)), p)
                zeros = word == 0
                spare = h - int(zeros.sum())
                again = spare < 0
                key = _mix(word ^ _place(kind, seed, p))
                own.append((key if again and seed == _SEEDS - 1 else key[~zeros]) & ~np.uint64(255) | np.uint64(kind & 255))
                if not again:
                    slack = 0 if seed else min(spare, 127)
                    break
            found.append(np.concatenate(own) if len(own) > 1 else own[0])
            slacks.append((kind, slack))
        return found, slacks

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """All keys of a set; linked sets that are not equal have one in common."""
        found, _ = self.keyed(elements)
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def near_size(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether size classes can hold linked sets."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        return self.den * (GRID[np.minimum(low + 1, len(GRID) - 1)] - 1) >= self.num * GRID[high]

    def may_meet(self, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ids under a key are of sizes that its scheme joins."""
        a, b = a & 1023, b & 1023
        across = key & 1 == 1  # a scheme of a border joins sets of two bands
        return self.near_size(a, b) & ((self.band[a] != self.band[b]) == across)


def _parities(x: np.ndarray, p: int) -> np.ndarray:
    """Each of ``p`` words is the exclusive or of 64 bits of each element that is dealt to it.

    An element changes one word, in about half of its bits. Were it one bit, words
    with one or two elements would be alike by chance in a share of all sets, and
    the pairs and hot keys that this makes would grow with the square of the input.
    """
    at = (x % np.uint64(p)).astype(np.uint16 if p <= 1 << 16 else np.int64)
    order = np.argsort(at, kind="stable")
    many = np.bincount(at, minlength=p)
    out = np.zeros(p, np.uint64)
    some = many > 0
    out[some] = np.bitwise_xor.reduceat(_mix(x * _MULTIPLIER)[order], (np.cumsum(many) - many)[some])
    return out


@cache
def _place(kind: int, seed: int, p: int) -> np.ndarray:
    at = (np.arange(p, dtype=np.uint64) * np.uint64(_SEEDS) + np.uint64(seed)) << np.uint64(16) ^ np.uint64(kind)
    return _mix(at * _MULTIPLIER)


def sketch(elements: np.ndarray) -> bytes:
    """Parity bits, as many as the next power of two over twice the set's size."""
    bits = max(64, 2 << int(len(elements)).bit_length())
    at = (_mix(elements) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance after the longer sketch is folded to the shorter: at most the symmetric difference."""
    while len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        half = len(b) // 2
        b = (int.from_bytes(b[:half], "little") ^ int.from_bytes(b[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def _print(u: np.ndarray) -> tuple[int, int]:
    """Id and print of a set, as signed longs: 54 bits of a hash with the size class, and 64 further bits."""
    d = xxhash.xxh3_128_digest(u.tobytes())
    high = int.from_bytes(d[:8], "little", signed=True)
    return (high & ~1023) | int(size_class(max(1, len(u)))), int.from_bytes(d[8:], "little", signed=True)


def _runs(key: np.ndarray, ids: np.ndarray, more: np.ndarray, ordered: bool = False):
    """Sorted and distinct (key, id) with ``more``, and each run's begin and length."""
    if not ordered:
        order = np.lexsort((ids, key))
        key, ids, more = key[order], ids[order], more[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, more = key[new], ids[new], more[new]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    return key, ids, more, begin, np.diff(np.append(begin, len(key)))


def _stars(key: np.ndarray, ids: np.ndarray, slack: np.ndarray):
    """Members of hot keys with centres: a class of near sizes has one, and is led to the next smaller class.

    Returns (key, id, slack, centre, head), head marking the classes' own centres.
    """
    kind = (ids & 1023) >> 2
    order = np.lexsort((ids, kind, key))
    key, ids, slack, kind = key[order], ids[order], slack[order], kind[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
    begin = np.flatnonzero(head)
    centre = np.repeat(ids[begin], np.diff(np.append(begin, len(key))))
    if len(begin) > 1:
        led = begin[1:][key[begin[1:]] == key[begin[:-1]]]
        centre[led] = centre[led - 1]
    return key, ids, slack, centre, head


_ROW = ["key", "id", "s", "info"]
_ROW_TYPES = "key long, id long, s int, info binary"
_WIDE = 256  # added to the slack of a row whose key was hot in its lot
_DOC, _STAR = -1, -1000  # s of documents; s of a member that its lot's star holds, plus its slack


def _row_batch(key, ids, s, info=None):
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.int32()), pa.array(info, pa.binary()) if info is not None else pa.nulls(len(key), pa.binary())], _ROW)


def _describe(n: int, scheme: Scheme):
    """Rows of three kinds: documents with size, print, slacks and sketch; (key, id) of each distinct set of a lot; members of keys that are hot in a lot.

    Of a key that is hot inside a lot only the centres of its star go where keys
    meet; the other members go anywhere. So a hot key sends few rows a lot to one place.
    """

    def run(batches):
        remember(_HASHES)
        for b in batches:
            at = 0
            while at < b.num_rows:
                end, held = at, 0
                keys, ids, slack, heads, info, prints, seen = [], [], [], [], [], [], set()
                while end < b.num_rows and held < _LOT:
                    for text in b.column(1).slice(end, 64).to_pylist():
                        u = shingles(text, n)
                        p = _print(u)
                        packed = 0
                        if len(u):
                            found, slacks = scheme.keyed(u)
                            for kind, s in slacks:
                                packed |= s << 8 * (kind % 3)
                            if p not in seen:
                                seen.add(p)
                                for k, (_, s) in zip(found, slacks):
                                    keys.append(k), ids.append(p[0]), slack.append(s)
                        heads.append((len(u), p[1], packed)), prints.append(p[0]), info.append(sketch(u) if len(u) else b"")
                        held += 200 + len(u)
                    end = min(b.num_rows, end + 64)
                m = end - at
                head = np.empty((m, 5), "<i8")
                head[:, :3] = heads
                doc, text_hash = b.column(0).slice(at, m), b.column(2).slice(at, m)
                head[:, 3], head[:, 4] = np.asarray(doc), np.asarray(text_hash)
                raw = head.tobytes()
                yield _row_batch(text_hash, prints, np.full(m, _DOC, np.int32), [raw[40 * k : 40 * k + 40] + x for k, x in enumerate(info)])
                at = end
                if not keys:
                    continue
                many = [len(k) for k in keys]
                key, own, more = np.concatenate(keys).view(np.int64), np.repeat(np.array(ids, np.int64), many), np.repeat(np.array(slack, np.int32), many)
                order = np.argsort(key, kind="stable")
                run = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
                wide = np.zeros(len(key), bool)
                wide[order] = np.bincount(run)[run] > NARROW
                yield _row_batch(key[~wide], own[~wide], more[~wide])  # set by set: ids that recur take little room
                if wide.any():
                    key, own, more, _, _ = _runs(key[wide], own[wide], more[wide])
                    key, own, more, centre, top = _stars(key, own, more)
                    yield _row_batch(key[top], own[top], more[top] + _WIDE)
                    rest = ~top
                    yield _row_batch(key[rest], own[rest], _STAR + more[rest], [x.tobytes() for x in centre[rest]])

    return run


_MET = ["what", "a", "b", "c", "d", "e", "f", "sketch"]
_MET_TYPES = "what int, a long, b long, c long, d long, e long, f long, sketch binary"


def _met(what: int, *cols, bits=None):
    m = len(cols[0])
    given = [pa.array(np.full(m, what, np.int32)), *(pa.array(c, pa.int64()) for c in cols)]
    given += [pa.nulls(m, pa.int64())] * (7 - len(given))
    return pa.RecordBatch.from_arrays([*given, pa.array(bits, pa.binary()) if bits is not None else pa.nulls(m, pa.binary())], _MET)


def _join_runs(scheme: Scheme):
    """What each key's sets give, and the documents; rows come sorted by key and id.

    0: a document (doc_id, n, id, print, slacks, text hash, sketch). 1: a pair
    (a, b, agreements that links need, scheme) of a key with few sets. 2: a member
    of a hot key (key, id, centre, slack). Of a key that goes over batches at most
    some thousand rows are held, and the centres handed out so far.
    """

    def hot(key, ids, slack, known):
        key, ids, slack, centre, top = _stars(key, ids, slack)
        if known is not None:
            for k in np.flatnonzero(top & (key == known[0])):
                centre[k] = known[1].setdefault(int(ids[k] & 1023) >> 2, ids[k])
        return _met(2, key, ids, centre, slack)

    def closed(key, ids, s, known):
        """Runs that are whole, or, of the key in ``known``, have been begun."""
        keep = s >= _WIDE
        if known is not None:
            keep |= key == known[0]
        same = key[1:] == key[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        key, ids, s = key[keep], ids[keep], s[keep]  # most keys have one set
        if not len(key):
            return
        flagged = np.unique(key[s >= _WIDE])
        key, ids, slack, begin, size = _runs(key, ids, s & (_WIDE - 1), ordered=True)
        wide = (size > NARROW) | np.isin(key[begin], flagged)
        if known is not None:
            wide |= key[begin] == known[0]
        for g in range(2, NARROW + 1):
            at = begin[(size == g) & ~wide]
            for i in range(g if len(at) else 0):
                for j in range(i + 1, g):
                    ok = at[scheme.may_meet(key[at], ids[at + i], ids[at + j])]
                    if len(ok):
                        kind = key[ok] & 255
                        need = 1 + np.maximum(slack[ok + i], slack[ok + j]).astype(np.int64) + scheme.surplus(kind, ids[ok + i], ids[ok + j])
                        yield _met(1, ids[ok + i], ids[ok + j], need, kind)
        if wide.any():
            member = np.repeat(wide, size)
            yield hot(key[member], ids[member], slack[member], known)

    def run(batches):
        remember()
        k = i = np.zeros(0, np.int64)
        s = np.zeros(0, np.int32)
        known = None
        for b in batches:
            key, ids, kind = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2))
            docs = np.flatnonzero(kind == _DOC)
            if len(docs):
                raw = b.column(3).take(pa.array(docs)).to_pylist()
                head = np.frombuffer(b"".join([x[:40] for x in raw]), "<i8").reshape(-1, 5)
                yield _met(0, head[:, 3], head[:, 0], ids[docs], head[:, 1], head[:, 2], head[:, 4], bits=[x[40:] for x in raw])
            star = np.flatnonzero(kind <= _STAR + 127)
            if len(star):
                centre = np.frombuffer(b"".join(b.column(3).take(pa.array(star)).to_pylist()), "<i8")
                yield _met(2, key[star], ids[star], centre, kind[star] - _STAR)
            plain = kind >= 0
            if not plain.any():
                continue
            key, ids, s = np.concatenate([k, key[plain]]), np.concatenate([i, ids[plain]]), np.concatenate([s, kind[plain]])
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from closed(key[:cut], ids[:cut], s[:cut], known)
                known = None
            k, i, s = key[cut:], ids[cut:], s[cut:]
            if len(i) > 8192:  # a hot key: hand out what is there, keep the centres
                known = known or (k[0], {})
                _, i, s, _, _ = _runs(k, i, s & (_WIDE - 1))
                yield hot(np.full(len(i), k[0]), i, s, known)
                k = i = np.zeros(0, np.int64)
                s = np.zeros(0, np.int32)
        if len(k):
            yield from closed(k, i, s, known)

    return run


def _near(scheme: Scheme):
    """Pairs whose sizes and sketches allow a link."""

    def run(batches):
        for b in batches:
            na, nb = np.asarray(b.column("na")), np.asarray(b.column("nb"))
            fits = (scheme.den * np.minimum(na, nb) >= scheme.num * np.maximum(na, nb)).tolist()
            most = [scheme.most(t) for t in (na + nb).tolist()]
            sa, sb = b.column("sa").to_pylist(), b.column("sb").to_pylist()
            ok = [f and distance(x, y) <= m for f, x, y, m in zip(fits, sa, sb, most)]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b", "support")], ["a", "b", "support"])

    return run


def _sets(n: int, sent):
    """(id, print, set) of the documents whose bit is on."""

    def run(batches):
        remember(_HASHES)
        bits = sent.value
        for b in batches:
            chosen = np.flatnonzero(_lit(bits, b.column(0)))
            for lot in range(0, len(chosen), 500):
                found = [shingles(t, n) for t in b.column(1).take(pa.array(chosen[lot : lot + 500])).to_pylist()]
                prints = [_print(u) for u in found]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([u.tobytes() for u in found], pa.binary())], ["hi", "lo", "elements"])

    return run


def _linked(num: int, den: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("ea"), b.column("eb")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


def _lit(bits: np.ndarray, ids) -> np.ndarray:
    """Whether the bits of ids (no nulls) are on."""
    at = (_mix(np.asarray(ids).astype(np.int64).view(np.uint64)) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def parted(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``rows`` with an id in two parts: those that surely have none of ``ids``, and the others, which are those with one and a few more.

    Nothing is shuffled; a bit set of ids is broadcast.
    """
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(ids))

    def part(on: bool):
        def run(batches):
            remember()
            for b in portions(batches):
                yield b.filter(pa.array(_lit(sent.value, b.column(id_col)) == on))

        return rows.where(F.col(f"`{id_col}`").isNotNull()).mapInArrow(run, rows.schema)

    return part(False), part(True)


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bit set of ids, made by aggregation: some 16 bits an id, between 128 KB and 16 MB; other ids may share a bit."""
    log2 = min(27, max(20, (16 * ids.count()).bit_length()))

    def place(batches):
        for b in batches:
            at = np.unique((_mix(np.asarray(b.column(0)).view(np.uint64)) & np.uint64((1 << log2) - 1)).astype(np.int64))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["w", "bits"])

    rows = ids.mapInArrow(place, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log2 - 6), np.int64)
    out[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    return out.view(np.uint8)


def _whole_sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(node, elements) of the asked nodes, each once.

    The bit set spares other documents' sets; which sets go on is decided by the
    join with the asked nodes, so it is whole however full the bit set is.
    """
    asked = stage(asked.distinct().join(nodes.select("node", "hi", "lo", "doc"), "node"), "asked")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(asked.select("doc")))
    sets = docs.mapInArrow(_sets(n, sent), "hi long, lo long, elements binary").join(asked.select("hi", "lo", "node"), ["hi", "lo"])
    return stage(sets.dropDuplicates(["node"]).select("node", "elements"), "sets")


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the staged pairs (a, b) of nodes that are linked, by their whole sets."""
    sets = _whole_sets(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), n)
    with_b = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    return stage(both.select("a", "b", "ea", "eb").mapInArrow(_linked(num, den), "a long, b long"), "linked")


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of +1 and -1, folded to the shortest one's length."""
    lengths = np.array([len(x) for x in sketches])
    size = int(lengths.min())
    out = np.empty((len(sketches), size * 8), np.float32)
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join([sketches[k] for k in own.tolist()]), np.uint8).reshape(len(own), n // size, size)
        out[own] = np.unpackbits(np.bitwise_xor.reduce(x, axis=1), axis=1)
    return 1 - 2 * out


def _halved(batches):
    """Rows with their sketches folded once, which is enough to tell unlike sets."""
    for b in batches:
        short = []
        for x in b.column("sketch").to_pylist():
            half = len(x) // 2
            short.append(x if half < 8 else (int.from_bytes(x[:half], "little") ^ int.from_bytes(x[half:], "little")).to_bytes(half, "little"))
        yield pa.RecordBatch.from_arrays([pa.array(short, pa.binary()) if n == "sketch" else b.column(n) for n in b.schema.names], b.schema.names)


_CELL = ["key", "low", "i", "j", "cross", "side", "node"]
_CELL_TYPES = "key long, low long, i int, j int, cross boolean, side int, node long, other long"
_PAIRS = 16  # candidates to a member of a cell: up to so many go on as pairs


def _candidates(scheme: Scheme, key: int, cross: bool, side, comp, sizes, ids, sketches):
    """Pairs of places in a cell, sides in order, whose components differ and whose sizes and sketches allow a link; in lots, with distances."""
    home = int((side == 0).sum())
    if not home or len(side) < 2:
        return
    x = folded(sketches)
    place = np.arange(len(side))
    for lo in range(0, home, 256):
        left, right = place[lo : min(home, lo + 256)], place[home if cross else lo :]
        apart = (x.shape[1] - x[left] @ x[right].T) / 2
        total = sizes[left][:, None] + sizes[right][None]
        fits = (scheme.den - scheme.num) * total >= (scheme.den + scheme.num) * apart
        fits &= comp[left][:, None] != comp[right][None]
        fits &= left[:, None] < right[None]
        i, j = np.nonzero(fits)
        far = apart[i, j]
        i, j = left[i], right[j]
        ok = scheme.may_meet(np.full(len(i), key), ids[i], ids[j])
        ok &= scheme.den * np.minimum(sizes[i], sizes[j]) >= scheme.num * np.maximum(sizes[i], sizes[j])
        yield i[ok], j[ok], far[ok]


def _busy(scheme: Scheme):
    """The candidates of a cell as pairs (node, other), which also meet in other cells and are then compared once; if they are very many, the members that have one, ``other`` being null."""

    def run(t):
        t = t.take(pa.array(np.argsort(np.asarray(t["side"]), kind="stable")))
        side, comp, sizes, ids, node = (np.asarray(t[c]) for c in ("side", "comp", "n", "hi", "node"))
        busy, few, held = np.zeros(len(side), bool), [], 0
        for i, j, _ in _candidates(scheme, t["key"][0].as_py(), t["cross"][0].as_py(), side, comp, sizes, ids, t["sketch"].to_pylist()):
            busy[i] = busy[j] = True
            held += len(i)
            few = [*few, (node[i], node[j])] if held <= _PAIRS * len(side) else []
        if held > _PAIRS * len(side):
            return t.select(_CELL).filter(pa.array(busy)).append_column("other", pa.nulls(int(busy.sum()), pa.int64()))
        a, b = (np.concatenate(x) for x in zip(*few)) if few else (np.zeros(0, np.int64),) * 2
        head = t.select(_CELL).take(pa.array(np.zeros(len(a), np.int64)))
        return head.set_column(6, "node", pa.array(np.minimum(a, b), pa.int64())).append_column("other", pa.array(np.maximum(a, b), pa.int64()))

    return run


def _inside(scheme: Scheme):
    """Links between the components of a cell, by whole sets: as few as connect what is connected in it, the nearest candidates first."""

    def run(t):
        t = t.take(pa.array(np.argsort(np.asarray(t["side"]), kind="stable")))
        side, comp, node, ids = (np.asarray(t[c]) for c in ("side", "comp", "node", "hi"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in t["elements"]]
        sizes = np.array([len(x) for x in sets], np.int64)
        up: dict[int, int] = {}

        def top(c):
            while up.get(c, c) != c:
                up[c] = c = up.get(up[c], up[c])
            return c

        a, b = [], []
        lots = list(_candidates(scheme, t["key"][0].as_py(), t["cross"][0].as_py(), side, comp, sizes, ids, [sketch(x) for x in sets]))
        if lots:
            i, j, far = (np.concatenate(x) for x in zip(*lots))
            order = np.argsort(far, kind="stable")
            for p, q in zip(i[order].tolist(), j[order].tolist()):
                c, d = top(int(comp[p])), top(int(comp[q]))
                if c == d:
                    continue
                x, y = sets[p], sets[q]
                same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if scheme.den * same >= scheme.num * (len(x) + len(y) - same):
                    up[max(c, d)] = min(c, d)
                    a.append(min(node[p], node[q])), b.append(max(node[p], node[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def linked_groups(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 2048) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, node) of every row of ``docs`` with an id; no link is lost.

    1. A distinct set is one node, with size, 128-bit print and a small parity sketch.
    2. Each set sends the words of its size band's sketches as keys. A key of few
       sets gives all pairs whose sizes allow a link; a hot key gives stars.
    3. Linked sets agree in more keys than either's slack, and in more yet if they
       are smaller than the largest sets of their scheme. So pairs with fewer
       agreements go; hot keys that both have count.
    4. Pairs whose sketches are too far apart cannot be linked and go. Of the
       rest, each node's best supported pair is verified on whole sets first; pairs
       inside the components that this gives need no verification any more.
    5. A set with no more hot keys than its slack meets its partners under other
       keys. Of the others, those in different components meet under their first
       hot keys in one order: all but as many as their slack. There sketches are compared in
       cells of bounded size. The candidates go on as pairs, each once however many
       keys they meet under, as in step 4; those of cells with very many go there as
       whole sets, each sent once to a cell. Only links that join components come out.

    ``node`` tells components apart where ids are repeated with other texts:
    null for sets without elements, else the same for all rows of a component.
    """
    scheme = Scheme(num, den)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    known = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash")).where("doc_id is not null")
    rows = known.mapInArrow(_describe(n, scheme), _ROW_TYPES)
    dealt = rows.repartition(F.when(F.col("s") >= 0, F.col("key")).otherwise(F.xxhash64("key", "id"))).sortWithinPartitions("key", "id")
    met = stage(dealt.mapInArrow(_join_runs(scheme), _MET_TYPES), "met")

    all_docs = met.where("what = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("hi"), F.col("d").alias("lo"), F.col("e").alias("slack"), F.col("f").alias("text_hash"), "sketch")
    nodes = all_docs.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("slack").alias("slack"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    hot = met.where("what = 2").select(F.col("a").alias("key"), F.col("b").alias("id"), F.col("c").alias("centre"), F.col("d").alias("slack"), F.col("a").bitwiseAND(F.lit(255)).alias("kind"))
    lists = stage(hot.groupBy("id", "kind").agg(F.collect_set("key").alias("keys"), F.max("slack").alias("s")), "lists")

    pairs = met.where("what = 1").groupBy("a", "b").agg(F.count("*").alias("support"), F.max("c").alias("need"), F.max("d").alias("kind"))
    pairs = stage(pairs, "support")
    few = pairs.where("support < need")
    for side in "ab":
        most = lists.select(F.col("id").alias("i"), F.col("kind").alias("k"), F.size("keys").alias("h"))
        few = few.join(most, (F.col(side) == F.col("i")) & (F.col("kind") == F.col("k")) & (F.col("support") + F.col("h") >= F.col("need"))).drop("i", "k", "h")
    for side in "ab":
        few = few.join(lists.select(F.col("id").alias(side), "kind", F.col("keys").alias(f"k{side}")), [side, "kind"])
    few = few.where(F.col("support") + F.size(F.array_intersect("ka", "kb")) >= F.col("need")).select("a", "b", "support")
    # stars only spare comparisons later on: a quarter of the keys shows near copies well enough
    star = hot.where("centre <> id and pmod(shiftright(key, 8), 4) = 0").groupBy(F.col("centre").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("support"), F.max("slack").alias("s")).where("4 * support > s").select("a", "b", "support")
    met_pairs = pairs.where("support >= need").select("a", "b", "support").union(few).union(star)
    left = nodes.select(F.col("hi").alias("a"), F.col("node").alias("da"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = nodes.select(F.col("hi").alias("b"), F.col("node").alias("db"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = met_pairs.join(left, "a").join(right, "b").where("da <> db")
    both = both.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), "support", "na", "nb", "sa", "sb")
    near = both.mapInArrow(_near(scheme), "a long, b long, support long").groupBy("a", "b").agg(F.sum("support").alias("support"))
    near = stage(near, "near")

    links, labels = _connected(known, nodes, near, None, n, scheme)

    named = nodes.join(labels.select(F.col("v").alias("node"), "label"), "node", "left").select("hi", "node", "n", "sketch", F.coalesce("label", "node").alias("comp"))
    named = stage(named.mapInArrow(_halved, named.schema), "named")
    cells = _loose_cells(lists, named, scheme, block)
    if cells is not None:
        cells = stage(cells, "cells")
        few = cells.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
        sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
        few = few.join(sides[0], "a").join(sides[1], "b").withColumn("support", F.lit(0).cast("long"))
        few = stage(few.select("a", "b", "support", "na", "nb", "sa", "sb").mapInArrow(_near(scheme), "a long, b long, support long"), "few")
        if few.limit(1).count():
            links, labels = _connected(known, nodes, few, links, n, scheme)
        found = _verified_inside(known, nodes, cells.where("other is null").drop("other"), named, n, scheme)
        if found is not None:
            links = stage(links.union(found), "links")
            labels = stage(components(links), "labels")

    home = nodes.select("hi", "lo", "doc", "node").join(labels.select(F.col("v").alias("node"), "label"), "node", "left").select("hi", "lo", "doc", F.coalesce("label", "node").alias("node"))
    home = stage(home, "home")
    least = home.groupBy("node").agg(F.min("doc").alias("component"))
    home = stage(home.select("hi", "lo", "node").join(least, "node"), "home")
    out = all_docs.select("doc_id", "n", "hi", "lo", "text_hash").join(home, ["hi", "lo"], "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "node")


def near_duplicates(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``, by ``linked_groups``.

    Null and empty texts have 0 shingles and are linked with nothing. Rows that
    repeat an id and text share its component; rows that repeat an id with
    another text are documents of their own under that id. Null ids take no part
    and have a null component. An empty table gives no rows. Other columns are ignored.
    """
    out = linked_groups(docs, n, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id")
    nameless = docs.where(F.col(f"`{id_col}`").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    return out.unionByName(nameless.mapInArrow(_sizes(n), "doc_id long, n_shingles long").withColumn("component_id", F.lit(None).cast("long")))


def _sizes(n: int):
    def run(batches):
        remember(_HASHES)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(shingles(t, n)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_shingles"])

    return run


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that no component holds both ends of."""
    la, lb = labels.select(F.col("v").alias("a"), F.col("label").alias("la")), labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
    return pairs.select("a", "b").join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _connected(docs: DataFrame, nodes: DataFrame, near: DataFrame, links: DataFrame | None, n: int, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """``links`` with those of the staged pairs (a, b, support) that are links, as many as components need, and the components' labels.

    Each node's best supported pair is verified first; then those of the others whose ends are still apart.
    """
    best = stage(near.groupBy("b").agg(F.max_by("a", F.struct("support", -F.col("a"))).alias("a")).select("a", "b"), "best")
    found = _verify(docs, nodes, best, n, scheme.num, scheme.den)
    links = found if links is None else stage(links.union(found), "links")
    labels = stage(components(links), "labels")
    apart = stage(_apart(near, labels).join(best, ["a", "b"], "left_anti").distinct(), "apart")
    if apart.limit(1).count():
        links = stage(links.union(_verify(docs, nodes, apart, n, scheme.num, scheme.den)), "links")
        labels = stage(components(links), "labels")
    return links, labels


def _loose_cells(lists: DataFrame, named: DataFrame, scheme: Scheme, block: int) -> DataFrame | None:
    """Members of hot keys that hold several components, dealt to cells of bounded size; None if there are none.

    Only sets with more hot keys than slack take part. If s is a set's slack,
    partners that agree in hot keys alone agree in more than s of them, so in one
    order of all keys the first one in which they agree is not among the set's last
    s: the others are compared, where they hold several components. A key with many
    members is split by size class, each class meeting itself and the next, and
    classes by blocks.
    """
    first = F.slice(F.array_sort("keys"), F.lit(1), F.size("keys") - F.col("s").cast("int"))
    some = lists.where(F.size("keys") > F.col("s")).select("id", F.explode(first).alias("key"))
    placed = stage(some.join(named.select(F.col("hi").alias("id"), "node", "comp"), "id").select("key", "node", "comp"), "placed")
    loose = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    loose = stage(loose, "loose")
    if not loose.limit(1).count():
        return None
    rows = placed.join(loose, "key", "left_semi").select("key", "node")
    rows = stage(rows.join(named.select("node", "hi", "n", "sketch", "comp"), "node"), "members")
    width = scheme.reach
    size = rows.groupBy("key", F.floor(F.col("hi").bitwiseAND(F.lit(1023)) / width).alias("cls")).agg(F.sum(1 + F.col("n") / 1000).alias("m"))
    size = stage(size.withColumn("g", F.sum("m").over(Window.partitionBy("key"))), "sizes")
    whole = rows.join(size.where(f"g <= {block}").select("key").distinct(), "key", "left_semi")
    whole = whole.select("key", F.lit(None).cast("bigint").alias("low"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.lit(False).alias("cross"), "node", "hi", "n", "sketch", "comp")
    large = size.where(f"g > {block}").select("key", "cls", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    if large.limit(1).count():
        whole = whole.union(_cells(rows, large, width))
    return whole.groupBy("key", "low", "i", "j", "cross").applyInArrow(_busy(scheme), _CELL_TYPES)


def _verified_inside(docs: DataFrame, nodes: DataFrame, cells: DataFrame, named: DataFrame, n: int, scheme: Scheme) -> DataFrame | None:
    """Links (a, b) inside the staged cells; None if there are none."""
    if not cells.limit(1).count():
        return None
    sets = _whole_sets(docs, nodes, cells.select("node"), n)
    full = cells.join(named.select("node", "hi", "comp"), "node").join(sets, "node")
    found = stage(full.groupBy("key", "low", "i", "j", "cross").applyInArrow(_inside(scheme), "a long, b long").distinct(), "found")
    return found if found.limit(1).count() else None


def _cells(rows: DataFrame, large: DataFrame, width: int) -> DataFrame:
    """Members of keys with many, dealt to pairs of cells: of one size class, or of two neighbours. A cell is a block of a class."""
    below = large.select("key", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("under"))
    above = large.select("key", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("over"))
    own = rows.withColumn("cls", F.floor(F.col("hi").bitwiseAND(F.lit(1023)) / width)).join(large, ["key", "cls"]).join(below, ["key", "cls"], "left").join(above, ["key", "cls"], "left")
    own = own.withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))

    def cells(count, make):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array().cast("array<struct<low:bigint,i:int,j:int,side:int,cross:boolean>>"))

    def cell(low, i, j, side, cross):
        return F.struct(low.alias("low"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"), cross.alias("cross"))

    at, cls = F.col("at"), F.col("cls")
    same = cells(F.col("blocks"), lambda k: cell(cls * 2, F.least(at, k), F.greatest(at, k), F.when(at <= k, 0).otherwise(1), at != k))
    down = cells(F.col("under"), lambda k: cell(cls * 2 - 1, k, at, F.lit(1), F.lit(True)))
    up = cells(F.col("over"), lambda k: cell(cls * 2 + 1, at, k, F.lit(0), F.lit(True)))
    dealt = own.withColumn("cell", F.explode(F.concat(same, down, up)))
    return dealt.select("key", "cell.*", "node", "hi", "n", "sketch", "comp")
