"""Exact top-k by inner product with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Above this, sums of products may not be exact in doubles.
_EXACT = float(1 << 53)
#: Stands for no score; its negative is representable.
_NONE = np.iinfo(np.int64).min + 1
_LONG = 1 << 63


def _vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v array<double>), v whole numbers, without vectors that are null or hold null or non-finite parts, before or after scaling."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x))  # doubles from 2^53 on are whole
    return df.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    flat, offsets = np.asarray(col.flatten()), np.asarray(col.offsets)
    return flat, np.diff(offsets)


def _top(a: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0))


def _products(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Integer inner products of the rows of a and b, exact: longs if they are ``small``, else Python's integers."""
    if small:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    out = np.zeros((len(a), len(b)), object)
    for x, y in zip(whole(a).T, whole(b).T):
        out += x[:, None] * y[None]
    return out


def block_index(vectors: DataFrame, rows: int = 256) -> DataFrame:
    """Blocks of ``rows`` vectors of one length: ids, forward index, and each term's largest and smallest value."""

    def build(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            flat, sizes = _matrix(b.column(1))
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                m = flat[starts[own][:, None] + np.arange(d)]if d else np.zeros((len(own), 0))
                lead = np.argsort(-np.abs(m), axis=1, kind="stable")[:, :2]  # vectors that lead in the same terms go together: their bounds are tight
                sign = np.take_along_axis(m, lead, 1) < 0
                order = np.lexsort([ids[own], *(x for j in range(lead.shape[1] - 1, -1, -1) for x in (sign[:, j], lead[:, j]))])
                for at in range(0, len(own), rows):
                    k = order[at : at + rows]
                    part = np.ascontiguousarray(m[k])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([len(k)], pa.int32()), pa.array([ids[own][k].astype("<i8").tobytes()], pa.binary()), *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (part, part.max(axis=0), part.min(axis=0)))],
                        ["d", "n", "ids", "forward", "high", "low"],
                    )

    return vectors.mapInArrow(build, "d int, n int, ids binary, forward binary, high binary, low binary")


def search_blocks(queries: tuple[np.ndarray, np.ndarray], blocks: list[tuple], k: int):
    """The k best of ``blocks`` for each query: arrays (query number, vec_id, score).

    For each query the blocks come in falling order of the sum over terms of the
    largest product the block allows; scoring stops at the first block whose
    bound lies below the k-th score so far. Equal bounds are still scored, since
    ties go to the smaller id. The query's own row is left out.
    """
    qid, q = queries
    if not len(qid) or not blocks:
        return [np.zeros(0, np.int64)] * 3
    small = _top(q) * max(_top(b[1]) for b in blocks) * max(1, q.shape[1]) < _EXACT
    none = _NONE if small else -(1 << 4200)  # below any product of doubles
    high, low = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bounds = _products(up, high, small) + _products(down, low, small)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best_s = np.full((len(qid), k), none, np.int64 if small else object)
    best_i = np.full((len(qid), k), np.iinfo(np.int64).max)
    alive = np.arange(len(qid))
    for step in range(len(blocks)):
        alive = alive[bounds[alive, order[alive, step]] >= best_s[alive, -1]]
        if not len(alive):
            break
        at = order[alive, step]
        for j in np.unique(at).tolist():
            own = alive[at == j]
            ids, forward = blocks[j][0], blocks[j][1]
            s = _products(q[own], forward, small)
            i = np.broadcast_to(ids, s.shape)
            skip = i == qid[own][:, None]
            s = np.concatenate([best_s[own], np.where(skip, none, s)], axis=1)
            i = np.concatenate([best_i[own], np.where(skip, np.iinfo(np.int64).max, i)], axis=1)
            rank = _rank(s, i, k)
            best_s[own] = np.take_along_axis(s, rank, 1)
            best_i[own] = np.take_along_axis(i, rank, 1)
    kept = best_i < np.iinfo(np.int64).max
    return [np.repeat(np.arange(len(qid)), k)[kept.ravel()], best_i[kept], best_s[kept]]


def _rank(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best by falling score, then rising id."""
    by_id = np.argsort(i, axis=1, kind="stable")
    by_score = np.argsort(-np.take_along_axis(s, by_id, 1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(by_id, by_score, 1)


def _query_blobs(parts: int):
    """Queries as (part, d, ids, vectors), some hundred to a row."""

    def build(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                lot = b.slice(at, 512)
                ids, part = np.asarray(lot.column(0)), np.asarray(lot.column(2))
                flat, sizes = _matrix(lot.column(1))
                begin = np.cumsum(sizes) - sizes
                for p, d in {*zip(part.tolist(), sizes.tolist())}:
                    own = np.flatnonzero((part == p) & (sizes == d))
                    v = flat[begin[own][:, None] + np.arange(d)] if d else np.zeros((len(own), 0))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([d], pa.int32()), pa.array([ids[own].astype("<i8").tobytes()], pa.binary()), pa.array([v.astype("<f8").tobytes()], pa.binary())], ["part", "d", "ids", "v"])

    return build


def _cell(k: int):
    """The k best of a group of blocks for each query of a part."""

    def run(queries, blocks):
        out = [[], [], [], [], []]
        if queries.num_rows and blocks.num_rows:
            d = queries["d"][0].as_py()
            ids = np.concatenate([np.frombuffer(x, "<i8") for x in queries["ids"].to_pylist()])
            q = np.concatenate([np.frombuffer(x, "<f8").reshape(-1, d) if d else np.zeros((len(i) // 8, 0)) for i, x in zip(queries["ids"].to_pylist(), queries["v"].to_pylist())])
            own = [(np.frombuffer(i, "<i8"), np.frombuffer(f, "<f8").reshape(n, d), np.frombuffer(h, "<f8"), np.frombuffer(lo, "<f8")) for n, i, f, h, lo in zip(*(blocks[c].to_pylist() for c in ("n", "ids", "forward", "high", "low")))]
            for at in range(0, len(ids), 1024):
                n, i, s = search_blocks((ids[at : at + 1024], q[at : at + 1024]), own, k)
                exact = [int(x) for x in s.tolist()]
                far = [0 if -_LONG <= x < _LONG else 1 if x > 0 else -1 for x in exact]
                out[0].append(ids[at : at + 1024][n])
                out[1].append(i)
                out[2] += [x if not f else _LONG - 1 if f > 0 else -_LONG for x, f in zip(exact, far)]
                out[3] += far
                out[4] += [(x + (1 << 4216)).to_bytes(528, "big") if f else None for x, f in zip(exact, far)]
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[:2]]
        return pa.table([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], ["query_id", "vec_id", "score", "far", "exact"])

    return run


def exact_topk(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, block_rows: int = 256, query_rows: int = 4096, group_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row whose id is divisible by ``every``.

    Vectors become floor(scale * x); those that are null or hold null or
    non-finite parts, before or after scaling, take no part, null ids neither; only
    vectors of one length are compared. Ties go to the smaller vec_id. Repeated ids
    are separate candidates, but never of a query with that id; a repeated query
    row counts once. Scores beyond the longs are ranked by their exact values and
    shown as the nearest long. An empty table gives no rows.

    Queries are dealt to parts of about ``query_rows``, blocks to groups of about
    ``group_bytes``; each part meets each group in one task, which holds no more
    than these two. Only numbers of rows and bytes come to the driver.
    """
    found = _vectors(vectors, id_col, vec_col, scale).where("vec_id is not null")
    blocks = stage(block_index(found, block_rows), "blocks")
    queries = stage(found.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]), "queries")
    parts = max(1, -(-queries.count() // query_rows))
    held = blocks.agg(F.sum(F.length("forward"))).first()[0] or 0
    groups = max(1, -(-held // group_bytes), min(64, blocks.count() // 8))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts).cast("long")).cast("int")
    asked = queries.select("vec_id", "v", part.alias("part")).mapInArrow(_query_blobs(parts), "part int, d int, ids binary, v binary")
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups).cast("long")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cell = ["part", "group", "d"]
    hits = asked.groupBy(*cell).cogroup(dealt.groupBy(*cell)).applyInArrow(_cell(k), "query_id long, vec_id long, score long, far int, exact binary")
    w = Window.partitionBy("query_id").orderBy(F.col("far").desc(), F.col("exact").desc(), F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
