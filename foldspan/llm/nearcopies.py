"""Near copies by SimHash and five-word shingles: documents whose shingle sets have a Jaccard similarity of at least 0.8.

Equal sets meet in one aggregate. Candidates are the links of the binary tries of SimHash fingerprints over the
shingles and, as copies near 0.8 differ in up to 17 of 64 bits, far beyond what tries can be joined at, those of a
second signature: MinHash bands, in whose buckets a maximum spanning forest over the estimated similarity, fewer edges
than members, connects whatever all pairs would. Every link is verified by the exact similarity of the two shingle
sets before components are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.llm.containment import shingle_hashes
from foldspan.llm.simhash import BUDGET, hamming_links, majority_bits
from foldspan.llm.textops import coded, mix64, pieces, split_words
from foldspan.plans.components import connected_components
from foldspan.plans.lineage import cut

SHINGLE, SIMILAR = 5, 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8 ** 4) ** 20 = 2.6e-5.
BANDS, ROWS = 20, 4
#: Estimates, of 80 hashes, from which an edge is verified: four and a half deviations below 0.8.
LEAST_ESTIMATE = 0.6
_RNG = np.random.default_rng(42)
_MUL, _ADD = (_RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)), _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _shingles(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` of the texts that have a word."""
    bounds, flat = split_words(batch.column("text"), lower=True)
    codes, words = coded(flat)
    table = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    hashes = table[codes]
    for i in range(batch.num_rows):
        if bounds[i + 1] > bounds[i]:
            yield i, np.unique(shingle_hashes(hashes[bounds[i] : bounds[i + 1]], k))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of the hash functions over the shingles."""
    low = np.full(len(_MUL), ~np.uint64(0))
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096, None] * _MUL + _ADD
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    return low


def digest(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows, sets, signs, bits = [], [], [], []
        for i, s in _shingles(batch, k):
            rows.append(i)
            sets.append(digest(s))
            signs.append(mix64(signature(s)).tobytes())
            bits.append(majority_bits(s))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("hash").take(at), pa.array(sets, pa.int64()), pa.array(signs, pa.binary()), pa.array(bits, pa.int64())], names=["id", "hash", "node", "signs", "bits"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of a signature: its bucket, and the signature by 16 bits a hash."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.uint64).reshape(batch.num_rows, BANDS, ROWS)
        short = [r.tobytes() for r in x.reshape(batch.num_rows, -1).astype(np.uint16)]
        bucket = np.zeros(x.shape[:2], np.uint64)
        for j in range(ROWS):
            bucket = mix64(bucket * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
        bucket = mix64(bucket + np.arange(BANDS, dtype=np.uint64))
        for b in range(BANDS):
            yield pa.RecordBatch.from_arrays([pa.array(bucket[:, b].view(np.int64)), batch.column("node"), pa.array(short, pa.binary())], names=["bucket", "node", "short"])


def spanning(signs: np.ndarray, least: float = LEAST_ESTIMATE) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a maximum spanning forest over the share of equal hashes, those of at least ``least`` (Prim)."""
    n = len(signs)
    nearest, best, left = np.zeros(n, np.int64), (signs == signs[0]).mean(axis=1), np.ones(n, bool)
    left[0], a, b = False, [], []
    for _ in range(n - 1):
        rest = np.flatnonzero(left)
        at = rest[best[rest].argmax()]
        if best[at] >= least:
            a.append(at)
            b.append(nearest[at])
        left[at] = False
        rest = np.flatnonzero(left)
        share = (signs[rest] == signs[at]).mean(axis=1)
        closer = rest[share > best[rest]]
        best[closer], nearest[closer] = share[share > best[rest]], at
    return np.array(a, np.int64), np.array(b, np.int64)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(a, b)``, a < b, of each bucket; the rows come sorted by bucket."""

    def of(t: pa.Table) -> pa.RecordBatch:
        bucket, node = t.column("bucket").to_numpy(), t.column("node").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(first[1:], len(bucket))
        some = ends - first > 1
        short, a, b = t.column("short"), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(first[some], ends[some], strict=True):
            signs = np.frombuffer(b"".join(short.slice(lo, hi - lo).to_pylist()), np.uint16).reshape(hi - lo, -1)
            i, j = spanning(signs)
            a.append(node[lo + i])
            b.append(node[lo + j])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        new = np.flatnonzero(bucket != bucket[-1])
        cut_at = int(new[-1]) + 1 if len(new) else 0  # the last bucket may go on in the next batch
        if held and held[-1].column("bucket")[-1].as_py() != bucket[0]:
            yield of(pa.Table.from_batches(held).combine_chunks())
            held = []
        if cut_at:
            yield of(pa.Table.from_batches([*held, batch.slice(0, cut_at)]).combine_chunks())
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield of(pa.Table.from_batches(held).combine_chunks())


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = {i: s.tobytes() for i, s in _shingles(batch, k)}
        at = pa.array(list(found), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("node").take(at), pa.array(list(found.values()), pa.binary())], names=["node", "shingles"])


def _jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both))
    return pa.array(out, pa.float64())


def similar_links(docs: DataFrame, signed: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``(a, b)``: pairs of distinct shingle sets (nodes) of at least ``similar`` that connect all such pairs."""
    nodes = signed.groupBy("node").agg(F.first("signs").alias("signs"))
    prints = cut(signed.select("node", "bits").distinct())
    first = prints.groupBy("bits").agg(F.min("node").alias("least"))
    alike = prints.join(first, "bits").where("node <> least").select(F.least("node", "least").alias("a"), F.greatest("node", "least").alias("b"))
    near = hamming_links(cut(first), "least", "bits", BUDGET).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    dealt = nodes.select("node", "signs").mapInArrow(_banded, "bucket bigint, node bigint, short binary")
    second = dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_edges, "a bigint, b bigint")
    edges = cut(second.unionByName(near).unionByName(alike).distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = signed.groupBy("node").agg(F.min("hash").alias("of")).join(ends, "node", "left_semi")
    texts = docs.select("hash", "text").join(wanted, F.col("hash") == F.col("of")).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
    sets = cut(texts.mapInArrow(lambda it: _sets(it, shingle), "node bigint, shingles binary"))
    pairs = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return pairs.where(F.arrow_udf(_jaccard, "double")(F.col("x"), F.col("y")) >= similar).select("a", "b")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``df`` with one row of each component of near copies: the one with the smallest id, null ids last.

    Rows are decided one by one, by id and text, so that rows without an id or with a repeated one go too if they are
    copies; of rows with equal id and text one stays. A-Z are lower-cased; a text of fewer words than a shingle is one
    shingle. Null and wordless texts are no copies of each other and stay. Texts of any length are taken whole. An
    empty table stays empty; other columns are passed on.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.col(text_col).cast("string").alias("text"))
    signed = cut(docs.mapInArrow(lambda it: _signed(it, shingle), "id bigint, hash bigint, node bigint, signs binary, bits bigint"))
    root = connected_components(similar_links(docs, signed, shingle, similar))
    rows = signed.select("id", "hash", "node").join(root, "node", "left").select("id", "hash", F.coalesce("root", "node").alias("of"))
    order = F.struct(F.col("id").isNull(), "id", "hash")
    first = rows.groupBy("of").agg(F.min(order).alias("first")).select(F.col("first.id").alias("__i"), F.col("first.hash").alias("__h"))
    # joined by row, not by component, of which one may hold a third of all rows
    stays = F.col("id").eqNullSafe(F.col("__i")) & (F.col("hash") == F.col("__h"))
    decided = cut(rows.groupBy("id", "hash").count().join(first, stays, "left").select("id", "hash", "count", F.col("__h").isNotNull().alias("stays")))
    gone = decided.where("not stays").select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
    repeated = decided.where("stays and count > 1").select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.lit(True).alias("__twice"))
    hashed = df.withColumn("__text", F.xxhash64(F.col(text_col).cast("string")))
    known = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash"))
    left = hashed.join(gone, known, "left_anti")
    if repeated.isEmpty():
        return left.drop("__text")
    marked = left.join(repeated, known, "left")
    once = marked.where("__twice").select(*hashed.columns).dropDuplicates([id_col, "__text"])
    return marked.where("__twice is null").select(*hashed.columns).unionByName(once).drop("__text")
