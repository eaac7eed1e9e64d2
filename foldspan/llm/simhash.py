"""Near duplicates by SimHash fingerprints and a self-join of binary tries.

Fingerprints that differ in at most ``budget`` bits agree on one of ``budget + 1`` blocks of bits. Each block in
turn leads a rotated fingerprint, and the fingerprints that share the leading bits form one binary trie. The trie
is joined with itself: pairs of nodes go down together, a pair of unlike children costs one error, and a pair
beyond the budget is left. Tries that hold too many fingerprints are split by blocks of their remaining bits, in
which again one block must agree, so that no task gets an unbounded trie and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.plans.components import connected_components
from foldspan.plans.lineage import cut

BUDGET, SHINGLE, SEED = 4, 4, 42
#: Fingerprints that one trie may hold before it is split.
TRIE_LIMIT = 4096


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """The fingerprint of one whole text as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([digest(joined, seed)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps.tolist(), len(joined)][shingle - 1 :]
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=False)), np.uint64, len(ends))
    return majority_bits(h)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 32768):
        part = hashes[k : k + 32768]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def simhash(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The 64-bit fingerprint of a text column; 0 where there is no word."""
    return F.arrow_udf(lambda t: pa.array([fingerprint(x, shingle, seed) for x in t.to_pylist()], pa.int64()), "bigint")(text.cast("string"))


def trie_pairs(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within each range [lo, hi) of ``x`` whose numbers differ in at most ``budget`` bits.

    ``x`` is sorted inside each range and its ``depth`` leading bits are equal there. Pairs of nodes (ranges of
    ``x``) go down one bit a round; those with at most ``leaf`` pairs below them are compared outright.
    """
    many = hi - lo > 1
    a0, a1, left = lo[many], hi[many], np.zeros(many.sum(), np.int64)
    b0, b1 = a0.copy(), a1.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(a0, a1, b0, b1):
        size = (a1 - a0) * (b1 - b0)
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // 2_000_000)) + 1):
            s = size[part]
            k = np.repeat(part, s)
            at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            i, j = a0[k] + at // (b1 - b0)[k], b0[k] + at % (b1 - b0)[k]
            ok = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            found.append((i[ok], j[ok]))

    for bit in range(depth, 64):
        small = (a1 - a0) * (b1 - b0) <= leaf
        if small.any():
            compare(a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, left = (v[~small] for v in (a0, a1, b0, b1, left))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((x >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = a0 != b0
        a0, a1, b0, b1, left = (
            np.concatenate(v)
            for v in (
                (a0, am, a0, am[other]),
                (am, a1, am, a1[other]),
                (b0, bm, bm, b0[other]),
                (bm, b1, b1, bm[other]),
                (left, left, left + 1, left[other] + 1),
            )
        )
        ok = (left <= budget) & (a1 > a0) & (b1 > b0) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, left = (v[ok] for v in (a0, a1, b0, b1, left))
    if len(a0):
        compare(a0, a1, b0, b1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def joined_tries(batches: Iterator[pa.RecordBatch], depth: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Star edges (node, root) of each trie; the rows come sorted by trie and number."""

    def stars(t: pa.Table) -> pa.RecordBatch:
        tree, x, node = (t.column(k).to_numpy() for k in ("tree", "turned", "node"))
        first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
        root = roots(len(x), *trie_pairs(x.view(np.uint64), first, np.append(first[1:], len(x)), depth, budget))
        linked = root != np.arange(len(x))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        tree = held.column("tree")
        last = pc.index(tree, tree[-1]).as_py()  # the last trie may go on in the next batch
        if last:
            yield stars(held.slice(0, last).combine_chunks())
            held = held.slice(last)
    if held is not None:
        yield stars(held.combine_chunks())


def turned(bits: Column, depth: int, by: int) -> Column:
    """The ``64 - depth`` low bits rotated left by ``by``; the leading bits stay."""
    if not by:
        return bits
    rest = 64 - depth
    low = bits if not depth else bits.bitwiseAND(F.lit((1 << rest) - 1))
    around = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, rest - by))
    if not depth:
        return around
    return bits.bitwiseAND(F.lit(-1 << rest)).bitwiseOR(around.bitwiseAND(F.lit((1 << rest) - 1)))


def hamming_links(nodes: DataFrame, node: str, bits: str, budget: int = BUDGET, limit: int = TRIE_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect all nodes whose bits differ in at most ``budget`` places.

    Not every such pair is returned, but every such pair is connected by the edges, of which each trie gives fewer
    than it has nodes. ``nodes`` has one row for each distinct ``bits``; nulls take no part.
    """
    blocks = budget + 1
    level = nodes.select(F.col(node).alias("node"), F.col(bits).alias("turned"), F.lit(0).cast("long").alias("turn")).where("node is not null and turned is not null")
    depth, parts = 0, []
    while level is not None:
        width = (64 - depth) // blocks
        kinds = [F.struct(turned(F.col("turned"), depth, k * width).alias("turned"), (F.col("turn") * (blocks + 1) + k + 1).alias("turn")) for k in range(blocks)]
        depth += width
        lead, turns = F.shiftrightunsigned("x.turned", 64 - depth), (blocks + 1) ** (len(parts) + 1)
        tree = F.col("x.turn") * (1 << depth) + lead if turns << depth < 1 << 63 else F.xxhash64("x.turn", lead)
        level = level.select("node", F.explode(F.array(*kinds)).alias("x")).select("node", "x.turned", tree.alias("tree"), "x.turn")
        crowded = None
        if (64 - depth) // blocks:
            crowded = cut(level.groupBy("tree").count().where(F.col("count") > limit).select("tree"))
            crowded = None if crowded.isEmpty() else crowded
        here = level if crowded is None else level.join(crowded, "tree", "left_anti")
        d = depth
        parts.append(here.select("tree", "turned", "node").repartition("tree").sortWithinPartitions("tree", "turned").mapInArrow(lambda it, d=d: joined_tries(it, d, budget), "a bigint, b bigint"))
        level = None if crowded is None else cut(level.join(crowded, "tree", "left_semi").select("node", "turned", "turn"))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return edges


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, limit: int = TRIE_LIMIT) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` of every row of ``df``; ids are whole numbers.

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the smallest id that the row reaches over
    fingerprints at most ``budget`` bits apart. Equal fingerprints meet in one aggregate before any join. A null
    or wordless text has fingerprint zero and is linked like any other. Rows without an id link nothing and get
    the component of their fingerprint, null if no row with an id has it. Repeated ids keep their rows. Texts of any
    length are read whole. An empty table has no rows; columns other than id and text are not read.
    """
    rows = cut(df.select(F.col(id_col).cast("long").alias("id"), simhash(F.col(text_col), shingle).alias("bits")))
    distinct = cut(rows.groupBy("bits").agg(F.min("id").alias("node")))
    root = connected_components(hamming_links(distinct, "node", "bits", budget, limit))
    named = distinct.join(root, "node", "left").select("bits", F.coalesce("root", "node").alias("component_id"))
    return rows.join(named, "bits").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
