"""Neighbour votes by exact search of all queries against all candidates, in pairs of blocks.

Queries and candidates are dealt into blocks of a bounded size, and each pair of blocks meets in one group of a shuffle.
A group multiplies its two matrices and keeps the best of each query, all of them where they tie; the bests of groups
are merged in a tree. No vector passes the driver. The approximate search deals by hash codes instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the vectors of one block, and bests that one step of the tree merges.
BLOCK_BYTES, BRANCHES = 8 << 20, 32
#: Distances that a group has in memory at once.
CELLS = 1 << 20
#: Candidates that a block holds at least while there are more tasks than blocks.
LEAST_BLOCK = 512
#: Digits of a distance that count; smaller differences are ties, which ids decide.
DIGITS = 12

_BEST = "query bigint, part int, best array<struct<near: double, id: bigint, y: double, distance: double>>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _sides(queries: DataFrame, candidates: DataFrame, id_col: str, vec: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates that have an id and a vector; vectors of floats stay so until they are matrices, as they are shuffled once a block."""
    kind = "array<float>" if {dict(df.dtypes)[vec] for df in (queries, candidates)} == {"array<float>"} else "array<double>"
    shape = [F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast(kind).alias("vec")]
    usable = F.col("id").isNotNull() & F.col("vec").isNotNull()
    return queries.select(*shape).where(usable), candidates.select(*shape, F.col(y).cast("double").alias("y")).where(usable)


def _paired(left: DataFrame, right: DataFrame, block_rows: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the keys (qb, cb) of the pairs of blocks they are in, and the number of candidate blocks.

    A row's block comes from a hash of id and vector, so that many rows of one id, or of one vector, are spread.
    """
    n, width = right.agg(F.count("*"), F.max(F.size("vec"))).first()
    rows = block_rows or max(256, BLOCK_BYTES // (8 * max(1, width or 1)))
    q_blocks = max(1, -(-left.count() // rows))
    idle = left.sparkSession.sparkContext.defaultParallelism // q_blocks
    c_blocks = max(1, -(-n // rows), min(idle, n // LEAST_BLOCK) if block_rows is None else 1)
    spread = F.xxhash64("id", "vec")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = left.withColumn("qb", F.pmod(spread, F.lit(q_blocks)).cast("int")).withColumn("cb", all_of(c_blocks))
    right = right.withColumn("cb", F.pmod(spread, F.lit(c_blocks)).cast("int")).withColumn("qb", all_of(q_blocks))
    return left, right, c_blocks


def _met(left: DataFrame, right: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _best_of(k: int, part: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of two blocks the ``k`` nearest candidates of each query by (distance, id), however many tie at the last place."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        rows: list[np.ndarray] = []
        ids, cand = _numbers(q.column("id")), _numbers(c.column("id"))
        if len(ids) and len(cand):
            lab, unit, m = _numbers(c.column("y")).astype(np.float64), _unit(_matrix(q.column("vec"))), _unit(_matrix(c.column("vec")))
            for s in range(0, len(ids), step := max(1, CELLS // len(cand))):
                d = 1 - unit[s : s + step] @ m.T
                near = np.round(d, DIGITS)
                near[ids[s : s + step, None] == cand[None, :]] = np.inf
                last = np.partition(near, min(k, len(cand)) - 1, axis=1)[:, min(k, len(cand)) - 1]
                at, of = np.nonzero((near <= last[:, None]) & np.isfinite(near))
                order = np.lexsort((cand[of], near[at, of], at))
                at, of = at[order], of[order]
                first = np.searchsorted(at, at)
                kept = np.arange(len(at)) - first < k
                at, of = at[kept], of[kept]
                rows.append(np.stack([at + s, of, near[at, of].view(np.int64), d[at, of].view(np.int64)]))
        at, of, near, dist = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), np.int64)
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        values = [pa.array(near.view(np.float64)), pa.array(cand[of] if len(of) else of), pa.array(lab[of] if len(of) else near.view(np.float64)), pa.array(dist.view(np.float64))]
        best = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.StructArray.from_arrays(values, names=["near", "id", "y", "distance"]))
        where = np.full(len(head), c.column(part)[0].as_py() if c.num_rows else 0, np.int32)
        return pa.table({"query": pa.array(ids[at[head]] if len(head) else head), "part": pa.array(where), "best": best})

    return run


def _merged(found: DataFrame, k: int, parts: int) -> DataFrame:
    """``(query, id, y, distance)`` from the bests of parts, ``BRANCHES`` at a time; a candidate that two parts name counts once."""
    while True:
        parts = -(-parts // BRANCHES)
        best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k)
        found = found.groupBy("query", F.floor(F.col("part") / BRANCHES).cast("int").alias("part")).agg(best.alias("best"))
        if parts <= 1:
            return found.select("query", F.explode("best").alias("x")).select("query", "x.id", "x.y", "x.distance")


def nearest(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "id", vec: str = "vec", y: str = "y", block_rows: int | None = None) -> DataFrame:
    """``(query, id, y, distance)``: the ``k`` candidates of least cosine distance, the query's own id left out; ties by id.

    Every query meets every candidate, in pairs of blocks of at most ``block_rows`` rows (by default what ``BLOCK_BYTES``
    hold). Rows without an id or a vector take no part; ids name queries, so that a query's rows should be one. Equal
    rows of candidates count once; a query with fewer than ``k`` others has as many as there are.
    """
    left, right, blocks = _paired(*_sides(queries, candidates, id_col, vec, y), block_rows)
    return _merged(_met(left, right, ["qb", "cb"], _best_of(k, "cb"), _BEST), k, blocks)


def hyperplanes(width: int, tables: int, bits: int, seed: int = 0) -> np.ndarray:
    """Random directions, (tables, bits, width); the signs of a vector's products with them are its code in a table."""
    return np.random.default_rng(seed).normal(size=(tables, bits, width))


def _coded(rows: DataFrame, planes: np.ndarray, probes: int) -> DataFrame:
    """``rows`` once for each table and code: their own, and with ``probes`` those with their least certain bits turned."""
    tables, bits, width = planes.shape

    def run(vec: pa.Array) -> pa.Array:
        m = _matrix(pa.chunked_array([vec]))
        out = np.empty((len(m), tables, probes + 1), np.int64)
        for t in range(tables if len(m) else 0):
            p = _unit(m) @ planes[t].T
            code = (p > 0) @ (1 << np.arange(bits))
            turn = np.argsort(np.abs(p), axis=1, kind="stable")[:, :probes]
            out[:, t] = np.concatenate([code[:, None], code[:, None] ^ (1 << turn)], axis=1) + (t << bits)
        flat = pa.array(out.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * tables * (probes + 1)), flat)

    return rows.withColumn("code", F.explode(F.arrow_udf(run, "array<bigint>")("vec")))


def nearest_by_codes(queries: DataFrame, candidates: DataFrame, k: int, tables: int = 8, bits: int = 4, probes: int = 2, id_col: str = "id", vec: str = "vec", y: str = "y", block_rows: int = 1 << 14, seed: int = 0) -> DataFrame:
    """As ``nearest``, from candidates only that share a sign code with the query in one of the ``tables``.

    Queries also look where the ``probes`` least certain bits of their code are turned. Codes with many candidates are
    dealt into blocks of about ``block_rows``, each of which meets the code's queries, which are dealt likewise. The search
    misses neighbours: measure its share with ``recall``. A query whose codes nobody shares has no row.
    """
    left, right = _sides(queries, candidates, id_col, vec, y)
    width = right.agg(F.max(F.size("vec"))).first()[0]
    if not width:
        return nearest(queries, candidates, k, id_col, vec, y)
    planes = hyperplanes(width, tables, bits, seed)
    left, right = _coded(left, planes, min(probes, bits)), _coded(right, planes, 0)
    spread = F.xxhash64("id", "vec")
    # at most tables * 2 ** bits rows
    sizes = right.groupBy("code").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("cn")).join(left.groupBy("code").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("qn")), "code")
    turns = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes, "code").withColumn("qb", F.pmod(spread, F.col("qn")).cast("int")).withColumn("cb", turns("cn"))
    right = right.join(sizes, "code").withColumn("cb", F.pmod(spread, F.col("cn")).cast("int")).withColumn("qb", turns("qn"))
    right = right.withColumn("part", F.pmod(F.xxhash64("code", "cb"), F.lit(BRANCHES)).cast("int"))
    shape = ["id", "vec", "code", "qb", "cb"]
    return _merged(_met(left.select(*shape), right.select(*shape, "y", "part"), ["code", "qb", "cb"], _best_of(k, "part"), _BEST), k, BRANCHES)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the exact neighbours, and the share of them that a search found."""
    hit = found.select("query", "id").distinct().withColumn("hit", F.lit(1))
    return exact.join(hit, ["query", "id"], "left").agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("recall"))


def smoothed_vote(near: DataFrame, prior: float, sharpness: float = 8.0, strength: float = 20.0, k: int = 40) -> DataFrame:
    """``(query, score)``: (k local + strength prior) / (k + strength), local weighted by exp(-sharpness distance).

    A query with fewer than ``k`` neighbours counts as many as it has.
    """
    w = F.exp(-sharpness * F.col("distance"))
    local = F.sum(w * F.col("y")) / F.sum(w)
    n = F.least(F.count("*"), F.lit(k))
    return near.groupBy("query").agg(((n * local + strength * prior) / (n + strength)).alias("score"))


def top1_purity(near: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of queries whose nearest candidate has their label; ``labels`` has id and y."""
    own = labels.select(F.col("id").alias("query"), F.col("y").cast("double").alias("own"))
    return near.join(own, "query").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("own")).cast("double")).alias("purity"))


def soft_vote(queries: DataFrame, candidates: DataFrame, tau: float = 0.1, id_col: str = "id", vec: str = "vec", y: str = "y", block_rows: int | None = None) -> DataFrame:
    """``(query, log_p)``: log of the softmax vote over all other candidates by minus Euclidean distance over ``tau``.

    Each pair of blocks gives for each query the largest exponent and sums relative to it; the parts are then put
    together. Rows without an id or a vector take no part.
    """
    left, right, _ = _paired(*_sides(queries, candidates, id_col, vec, y), block_rows)

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        ids, cand = _numbers(q.column("id")), _numbers(c.column("id"))
        if len(ids) and len(cand):
            lab, a, m = _numbers(c.column("y")).astype(np.float64), _matrix(q.column("vec")), _matrix(c.column("vec"))
            size = (m * m).sum(1)[None, :]
            for s in range(0, len(ids), step := max(1, CELLS // len(cand))):
                p = a[s : s + step]
                e = -np.sqrt(np.maximum((p * p).sum(1)[:, None] + size - 2 * p @ m.T, 0)) / tau
                e[ids[s : s + step, None] == cand[None, :]] = -np.inf
                top = e.max(axis=1)
                ok = np.isfinite(top)
                w = np.exp(e[ok] - top[ok, None])
                out.append((ids[s : s + step][ok], top[ok], w.sum(1), w @ lab))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), *(np.zeros(0) for _ in range(3))]
        return pa.table(dict(zip(("query", "top", "total", "hits"), map(pa.array, columns), strict=True)))

    found = _met(left, right, ["qb", "cb"], run, "query bigint, top double, total double, hits double")
    best = found.groupBy("query").agg(F.max("top").alias("best"), F.collect_list(F.struct("top", "total", "hits")).alias("parts"))
    scaled = lambda name: F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.exp(x["top"] - F.col("best")) * x[name])
    return best.select("query", F.log(F.greatest(scaled("hits") / scaled("total"), F.lit(1e-300))).alias("log_p"))
