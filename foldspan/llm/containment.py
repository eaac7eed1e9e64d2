"""Benchmark decontamination: short items found inside long documents.

Items are partitioned by their number of distinct shingles. Each partition has its own index of MinHash signatures:
of an item the smallest shingle hashes, so many that a document that holds the asked share of any item of the
partition must hold one of them (an item of n shingles of which at most n - ceil(share * n) are missing cannot have
lost more hashes than that). A document, at any length, is sketched once for each partition by its shingle hashes up
to the largest hash of the partition's signatures, as no other can meet one. Items whose signature meets the sketch
are candidates and are verified by the exact share of the item's shingles (compared as words) that the document has.
Unlike signatures of a fixed number of hash functions these lose no item at any ratio of the sizes.

Null and wordless texts match nothing. Texts are searched whole. An item of fewer words than a shingle is one shingle,
so only documents of just these words hold it. Equal items are all found, as are equal documents. Without documents or
items nothing is found. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspan.llm.textops import coded, mix64, pieces, split_words

SHINGLE, SHARE = 5, 0.8
#: Items and text bytes of one block of the query set; each block is one pass over the documents.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 64 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes; of all words together where there are fewer."""
    n = max(1, len(words) - k + 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = h * _STEP + mix64(words[i : i + n])
    return mix64(h)


class Partition:
    """The signatures of the items of one size class, by hash."""

    def __init__(self, largest: int, share: float):
        self.length = largest - math.ceil(share * largest) + 1
        self.filed: dict[int, list[int]] = {}

    def add(self, item: int, hashes: list[int]) -> None:
        for h in sorted(hashes)[: self.length]:
            self.filed.setdefault(h, []).append(item)

    def close(self) -> None:
        self.hashes = np.array(sorted(self.filed), np.uint64)
        self.owners = [self.filed[int(h)] for h in self.hashes]
        self.filed = {}

    def candidates(self, hashes: np.ndarray) -> set[int]:
        sketch = hashes[hashes <= self.hashes[-1]]
        at = np.searchsorted(self.hashes, sketch)
        return {o for i in np.unique(at[self.hashes[at] == sketch]) for o in self.owners[i]}


class ItemIndex:
    """One block of items: an index for each size class, and the exact shingles of each item."""

    def __init__(self, items: list[tuple[int, str]], k: int, share: float):
        self.k, self.share, self.ids, self.shingles = k, share, [], []
        sizes: dict[int, Partition] = {}
        for item, text in items:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if not words:
                continue
            runs = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
            largest = 1 << (len(runs) - 1).bit_length()  # size classes end at powers of two
            hashes = {int(shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in r], np.uint64), k)[0]) for r in runs}
            sizes.setdefault(largest, Partition(largest, share)).add(len(self.ids), list(hashes))
            self.ids.append(item)
            self.shingles.append(runs)
        self.partitions = [sizes[n] for n in sorted(sizes)]
        for p in self.partitions:
            p.close()

    def candidates(self, hashes: np.ndarray) -> list[int]:
        return sorted(set().union(*(p.candidates(hashes) for p in self.partitions))) if len(hashes) else []

    def verified(self, words: list[bytes], candidates: list[int]) -> Iterator[tuple[int, int, int]]:
        runs = {tuple(words[i : i + self.k]) for i in range(max(1, len(words) - self.k + 1))}
        for c in candidates:
            both = len(runs & self.shingles[c])
            if both >= self.share * len(self.shingles[c]):
                yield self.ids[c], len(self.shingles[c]), both

    def search(self, text: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
        """For each text the items that it holds, their shingles and those that it has of them."""
        bounds, flat = split_words(text, lower=True)
        codes, dictionary = coded(flat)
        table = np.fromiter((xxhash.xxh64_intdigest(w) for w in dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(dictionary))
        hashes = table[codes]
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            some = self.candidates(shingle_hashes(hashes[lo:hi], self.k))
            yield list(self.verified(text[i].as_py().encode("utf-8", "surrogatepass").lower().split(), some)) if some else []


def _search(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out = [(doc, *v) for doc, found in zip(batch.column("id").to_pylist(), index.value.search(batch.column("text")), strict=True) for v in found]
        names = ["doc", "item", "n_shingles", "n_shared"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=names)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def item_indexes(items: DataFrame, item_id: str, text_col: str, shingle: int, share: float) -> list:
    """Broadcast indexes of the items that have a text, in blocks of bounded size: the stated query set of the search."""
    spark = items.sparkSession
    wanted = items.select(F.col(item_id).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    indexes = [ItemIndex(block, shingle, share) for block in _blocks(wanted)]
    return [spark.sparkContext.broadcast(x) for x in indexes if x.ids]


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", item_text_col: str = "text", shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` of the documents that hold ``share`` of an item's distinct shingles.

    A-Z are lower-cased. Items go over the documents in blocks of bounded size; documents need no shuffle. Rows with a
    null id are not named here (``decontaminate`` searches them too); repeated rows give repeated results. Where both
    ids have one name that of the item gets ``item_`` before it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    found = None
    for index in item_indexes(items.where(F.col(item_id).isNotNull()), item_id, item_text_col, shingle, share):
        part = rows.mapInArrow(lambda it, index=index: _search(it, index), "doc bigint, item bigint, n_shingles bigint, n_shared bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "doc bigint, item bigint, n_shingles bigint, n_shared bigint")
    named = f"item_{item_id}" if item_id == doc_id else item_id
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(named), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """``docs`` without those that hold an item.

    Each row is judged by its own text where it lies, so that rows without an id or with a repeated one are too. Rows
    with a null text stay. Items need no id.
    """

    def holds(index):
        def run(text: pa.Array) -> pa.Array:
            out = []
            for batch in pieces([pa.RecordBatch.from_arrays([text], names=["text"])]):
                out += [bool(found) for found in index.value.search(batch.column("text"))]
            return pa.array(out, pa.bool_())

        return F.arrow_udf(run, "boolean")

    for index in item_indexes(items, item_id, item_text_col, shingle, share):
        docs = docs.where(~holds(index)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return docs
