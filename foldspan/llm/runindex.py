"""Removal of long repeated byte strings by run-length indexes (r-indexes).

Every string of ``length`` bytes has a smallest gram (by hash), its anchor, and equal strings have equal anchors.
Anchors that occur once in all texts rule out most bytes; what is left, the candidate regions, is dealt by shorter
anchors, so that equal strings meet. Each deal is indexed in blocks: a run-compressed Burrows-Wheeler transform with
the text positions of the ends of its runs. Matching statistics (how long the string that starts at a position occurs
elsewhere) stream from the run ends inside a block, and by backward steps through the index for strings of other
blocks. Strings whose match is long enough are removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspan.llm.textops import mix64, pieces
from foldspan.plans.lineage import ensure_checkpoint_dir

LENGTH = 400
#: Bytes that one index holds. Ranks of its positions must fit in 21 bits.
BLOCK = 1 << 20
#: Bytes hashed at once, and anchors that a task compares at once.
STRETCH, HELD = 1 << 18, 1 << 20
#: No byte of UTF-8 text.
SEPARATOR = 0xFF


def grams(length: int) -> tuple[int, int]:
    """Bytes of the grams that rule out bytes, and of those that deal regions: a half and a twelfth of ``length``."""
    return max(1, length // 2), max(1, length // 12)


# Anchors.

_FACTOR = 0x9E3779B97F4A7C15
_CODES = mix64(np.arange(256)) | np.uint64(1)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-byte strings of ``b``: differences of a prefix sum of weighted bytes, brought to one weight."""
    up, down = np.full(len(b), _FACTOR, np.uint64), np.full(len(b), pow(_FACTOR, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_CODES[b] * np.cumprod(up), out=total[1:])
    return mix64((total[k:] - total[:-k]) * np.cumprod(down)[: len(b) - k + 1])


def over_windows(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (a numpy minimum or maximum) of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x, done = best(x[:-done], x[done:]), done * 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(flat: np.ndarray, bounds: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all texts, which lie one after another in ``flat``.

    In every string of ``length`` bytes of one text all grams of the smallest hash are anchors.
    """
    w, at, found = length - k + 1, [], []
    for a in range(0, len(flat) - length + 1, STRETCH):
        part = flat[a : a + STRETCH + length - 1]
        h = gram_hashes(part, k)
        low = over_windows(h, w, np.minimum)
        inner = bounds[np.searchsorted(bounds, a, side="right") : np.searchsorted(bounds, a + len(part))]
        for end in (inner - a).tolist():
            low[max(0, end - length + 1) : end] = 0  # reaches into the next text
        high = over_windows(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
        here = np.flatnonzero((high == h) & (h > 0))
        at.append(here + a)
        found.append(h[here])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(found)[first]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and the bounds of each (one more than texts); a null has none."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


ANCHOR_ROW = "h bigint, k bigint, first int, last int, known boolean"


def anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Anchors of texts (k1, text); neighbours with one hash are one row. ``known``: the task has the hash twice.

    Copies of a text that the task has had are skipped, so that only different texts make a hash known.
    """
    seen: set[int] = set()
    held: list[tuple[np.ndarray, ...]] = []

    def told() -> pa.RecordBatch:
        h, k, first, last, many = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, code, count = np.unique(h, return_inverse=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(many | (count[code] > 1))], names=["h", "k", "first", "last", "known"])

    for batch in pieces(batches):
        keys = batch.column("k1").to_numpy()
        new = [not (x in seen or seen.add(x)) for x in keys.tolist()]
        if not all(new):
            batch = batch.filter(pa.array(new))
            keys = batch.column("k1").to_numpy()
        flat, bounds = flat_bytes(batch.column("text"))
        if len(flat) < length:
            continue
        at, h = anchors(flat, bounds, grams(length)[0], length)
        if not len(at):
            continue
        doc = np.searchsorted(bounds, at, side="right") - 1
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
        tail = np.append(head[1:], len(at)) - 1
        held.append((h[head], keys[doc[head]], at[head] - bounds[doc[head]], at[tail] - bounds[doc[tail]], tail > head))
        if sum(len(x[0]) for x in held) > HELD:
            yield told()
    if held:
        yield told()


# Regions.


def united(lo: np.ndarray, hi: np.ndarray, by: np.ndarray | None = None, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans [lo, hi) of equal ``by`` that overlap (or lie at most ``slack`` apart), and the index of one span of each."""
    by = np.zeros(len(lo), np.int64) if by is None else by
    order = np.lexsort((lo, by))
    lo, hi, by = lo[order], hi[order], by[order]
    first = np.concatenate([[True], by[1:] != by[:-1]])
    group = np.cumsum(first) - 1
    far = int(hi.max(initial=0)) + 1
    reach = np.maximum.accumulate(hi + group * far) - group * far
    new = first.copy()
    new[1:] |= lo[1:] > reach[:-1] + slack
    start = np.flatnonzero(new)
    return lo[start], np.maximum.reduceat(hi, start) if len(start) else hi, order[start]


SEGMENT_ROW = "h bigint, k1 bigint, k2 bigint, start int, bytes binary"


def segment_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The pieces of candidate regions around each of their short anchors; rows have k1, k2, text and ``at`` (first, last)."""
    wide, narrow = (length - k for k in grams(length))
    for batch in pieces(batches):
        flat, bounds = flat_bytes(batch.column("text"))
        spans = batch.column("at")
        doc = pc.list_parent_indices(spans).to_numpy()
        first, last = (pc.struct_field(spans.flatten(), i).to_numpy().astype(np.int64) + bounds[doc] for i in (0, 1))
        lo, hi = np.maximum(first - wide, bounds[doc]), np.minimum(last + length, bounds[doc + 1])
        ok = hi - lo >= length
        lo, hi, one = united(lo[ok], hi[ok], doc[ok])
        if not len(lo):
            continue
        doc = doc[ok][one]
        joined = np.concatenate([flat[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        edge = np.concatenate([[0], np.cumsum(hi - lo)])
        at, h = anchors(joined, edge, length - narrow, length)
        region = np.searchsorted(edge, at, side="right") - 1
        a, b = np.maximum(at - narrow, edge[region]), np.minimum(at + length, edge[region + 1])
        same = np.unique(np.stack([region.astype(np.uint64), h], 1), axis=0, return_inverse=True)[1].ravel()
        a, b, one = united(a, b, same)
        region, h = region[one], h[one]
        start = a - edge[region] + lo[region] - bounds[doc[region]]
        cut = [joined[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        k1, k2 = (batch.column(c).to_numpy()[doc[region]] for c in ("k1", "k2"))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(start.astype(np.int32)), pa.array(cut, pa.binary())], names=["h", "k1", "k2", "start", "bytes"])


# The index.


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Text positions in the order of their suffixes (a suffix that ends comes first), by doubling ranks of those still tied."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(5, np.uint8)]).astype(np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(5):
        value = (value << np.uint64(8)) | padded[k : k + n]
    mask, bits = np.uint64((1 << 21) - 1), np.uint64(21)
    key = np.sort((value << bits) | np.arange(n, dtype=np.uint64))
    where, major = (key & mask).astype(np.int64), key >> bits
    place = np.arange(n)
    rank, depth = np.zeros(n + 1, np.int64), 5  # ranks from 1: the first place of the group

    def ranked(where, place, new):
        head = np.maximum.accumulate(np.where(new, place, 0))
        rank[where] = head + 1
        alone = new & np.append(new[1:], True)
        return where[~alone]

    tied = ranked(where, place, np.concatenate([[True], major[1:] != major[:-1]]))
    while len(tied):
        second = rank[np.minimum(tied + depth, n)]
        key = np.sort((rank[tied].astype(np.uint64) << np.uint64(42)) | (second.astype(np.uint64) << bits) | tied.astype(np.uint64))
        where, both, group = (key & mask).astype(np.int64), key >> bits, (key >> np.uint64(42)).astype(np.int64)
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(key))
        place = group - 1 + at - np.maximum.accumulate(np.where(opens, at, 0))
        tied = ranked(where, place, np.concatenate([[True], both[1:] != both[:-1]]))
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank[:n] - 1] = np.arange(n)
    return out


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(text) + 1, 8), (1, 1)).copy().view("<u8").ravel()


def common(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Equal bytes from position ``a`` of one text and ``b`` of another, given as words, up to ``limit``."""
    out, open_ = limit.copy(), np.flatnonzero(limit > 0)
    done = 0
    while len(open_):
        unlike = x[np.minimum(a[open_] + done, len(x) - 1)] ^ y[np.minimum(b[open_] + done, len(y) - 1)]
        ends = np.flatnonzero(unlike)
        lowest = unlike[ends] & (~unlike[ends] + np.uint64(1))
        out[open_[ends]] = np.minimum(limit[open_[ends]], done + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
        done += 8
        goes_on = (unlike == 0) & (limit[open_] > done)
        open_ = open_[goes_on]
    return out


class RunIndex:
    """The runs of the Burrows-Wheeler transform of a text: byte, first row and text positions of the first and last row."""

    def __init__(self, text: np.ndarray):
        self.n, self.words = len(text), words_of(text)
        sa = suffix_array(text)
        before = text[sa - 1].astype(np.int16)
        before[sa == 0] = 256  # what stands before the text is a byte of its own
        self.start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        end = np.append(self.start[1:], self.n) - 1
        self.head, self.first, self.last = before[self.start], sa[self.start], sa[end]
        self.size = end - self.start + 1
        self._above, self._below = sa[self.start - 1], sa[np.minimum(end + 1, self.n - 1)]
        # runs by byte, with the rows that each byte's runs hold before them
        self.by_byte = np.argsort(self.head, kind="stable")
        self.key = self.head[self.by_byte].astype(np.int64) * (len(self.head) + 1) + self.by_byte
        rows = np.cumsum(self.size[self.by_byte]) - self.size[self.by_byte]
        self.to = np.empty(len(self.head), np.int64)
        self.to[self.by_byte] = rows
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])
        lower = np.concatenate([[0], np.cumsum(np.bincount(self.head, weights=self.size, minlength=257).astype(np.int64))])
        self.to += (smaller[self.head] - lower[self.head]) * (self.head < 256)

    def own_matches(self) -> np.ndarray:
        """For each position the length of the longest string from there that starts at another position too.

        A suffix has its longest match in a neighbour. Inside a run both have the same byte before them, so the
        length falls by one from a position to the next one; only the ends of runs are compared.
        """
        out = np.zeros(self.n, np.int64)
        for sample, other, valid in ((self.first, self._above, self.start > 0), (self.last, self._below, self.start + self.size < self.n)):
            limit = np.where(valid, self.n - np.maximum(sample, other), 0)
            lengths = common(self.words, sample, self.words, other, limit)
            order = np.argsort(sample)
            near = np.searchsorted(sample[order], np.arange(self.n), side="right") - 1
            near = order[near]
            out = np.maximum(out, lengths[near] - (np.arange(self.n) - sample[near]))
        return out

    def matching_statistics(self, patterns: list[np.ndarray], most: int) -> list[np.ndarray]:
        """For each position of each pattern the length, up to ``most``, of the longest string from there in the index.

        All patterns go backwards together, one byte a step. In a run of the byte a step is exact; elsewhere the
        nearest runs of the byte above and below offer their ends, and the one with the longer match is taken.
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        base = np.cumsum(sizes) - sizes
        flat = np.concatenate([*patterns, np.zeros(0, np.uint8)])
        words, out = words_of(flat), np.zeros(len(flat), np.int64)
        order = np.argsort(-sizes, kind="stable")
        row, pos, length = (np.zeros(len(patterns), np.int64) for _ in range(3))
        pos[:] = self.first[0]
        runs = len(self.head)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = order[: np.searchsorted(-sizes[order], -step, side="right")]
            at = base[live] + sizes[live] - step
            byte = flat[at].astype(np.int64)
            r, p, ln = row[live], pos[live], length[live]
            run = np.searchsorted(self.start, r, side="right") - 1
            fits = self.head[run] == byte
            j = np.searchsorted(self.key, byte * (runs + 1) + run)
            turn = np.flatnonzero(~fits)
            if len(turn):
                jt, bt = j[turn], byte[turn]
                down = np.minimum(jt, runs - 1)
                has_down = (jt < runs) & (self.head[self.by_byte[down]] == bt)
                has_up = (jt > 0) & (self.head[self.by_byte[jt - 1]] == bt)
                up_run, down_run = self.by_byte[jt - 1], self.by_byte[down]
                after, reach = at[turn] + 1, ln[turn]
                up = common(words, after, self.words, self.last[up_run], np.where(has_up, np.minimum(reach, self.n - self.last[up_run]), 0))
                dn = common(words, after, self.words, self.first[down_run], np.where(has_down, np.minimum(reach, self.n - self.first[down_run]), 0))
                above = has_up & (~has_down | (up >= dn))
                run[turn] = np.where(above, up_run, np.where(has_down, down_run, run[turn]))
                r[turn] = np.where(above, self.start[up_run] + self.size[up_run] - 1, np.where(has_down, self.start[down_run], 0))
                p[turn] = np.where(above, self.last[up_run], np.where(has_down, self.first[down_run], self.first[0]))
                ln[turn] = np.where(above, up, dn)
            steps = self.head[run] == byte
            row[live] = np.where(steps, self.to[run] + r - self.start[run], 0)
            pos[live] = np.where(steps, p - 1, self.first[0])
            length[live] = out[at] = np.where(steps, np.minimum(ln + 1, most), 0)
        return np.split(out, base[1:]) if len(patterns) else []


def repeated_starts(regions: list[bytes], length: int = LENGTH, block: int = BLOCK) -> list[np.ndarray]:
    """For each region whether the string of ``length`` bytes from each position is found again, in it or in another one.

    Regions are indexed in blocks of about ``block`` bytes; those of other blocks stream through each index. A longer
    region is cut where pieces share ``length - 1`` bytes, so that no string of that length is in two of them.
    """
    parts: list[tuple[int, int, np.ndarray]] = []
    half = max(1, block // 2)
    for i, r in enumerate(regions):
        b = np.frombuffer(r, np.uint8)
        for a in range(0, max(1, len(b) - length + 1), half):
            parts.append((i, a, b[a : a + half + length - 1]))
    out = [np.zeros(len(r), bool) for r in regions]

    def mark(part: tuple[int, int, np.ndarray], lengths: np.ndarray) -> None:
        i, a, b = part
        n = max(0, len(b) - length + 1)
        out[i][a : a + n] |= lengths[:n] >= length

    cut = np.cumsum([len(p[2]) + 1 for p in parts]) // half
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(parts)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = parts[lo:hi]
        text = np.concatenate([x for p in inside for x in (p[2], np.array([SEPARATOR], np.uint8))])
        index = RunIndex(text)
        own = index.own_matches()
        at = 0
        for p in inside:
            mark(p, own[at : at + len(p[2])])
            at += len(p[2]) + 1
        rest = [*parts[:lo], *parts[hi:]]
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for p, found in zip(some, index.matching_statistics([p[2] for p in some], length), strict=True):
                mark(p, found)
    return out


REMOVED_ROW = "k1 bigint, k2 bigint, a int, b int"


def removed_rows(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove; the segments come sorted by anchor. Whole anchors fill a block; pieces of one text are united first."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        k1, k2, start = (t.column(c).to_numpy() for c in ("k1", "k2", "start"))
        data = t.column("bytes").to_pylist()
        start = start.astype(np.int64)
        end = start + np.array([len(x) for x in data])
        text = np.unique(np.stack([k1, k2], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((start, text))
        # a piece that shares less than a string with the one before stays apart
        lo, hi, one = united(start, end, text, slack=-length)
        owner = text[one]
        regions = [bytearray(n) for n in (hi - lo).tolist()]
        at = np.searchsorted(owner * (1 << 32) + lo, text * (1 << 32) + start, side="right") - 1
        for i in order.tolist():
            a = int(start[i] - lo[at[i]])
            regions[at[i]][a : a + len(data[i])] = data[i]
        where: dict[bytes, int] = {}
        code = [where.setdefault(bytes(r), len(where)) for r in regions]
        times = np.bincount(code)
        marks = repeated_starts(list(where), length, block)
        rows = []
        for j, c in enumerate(code):
            s = np.flatnonzero(marks[c]) if times[c] == 1 else np.arange(len(regions[j]) - length + 1)
            if len(s):
                head = np.flatnonzero(np.concatenate([[True], np.diff(s) > length]))
                tail = np.append(head[1:], len(s)) - 1
                rows.append((np.full(len(head), one[j]), s[head] + lo[j], s[tail] + lo[j] + length))
        who, a, b = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(k1[who]), pa.array(k2[who]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["k1", "k2", "a", "b"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        grown = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy())
        begun, taken = 0, 0
        changes = np.flatnonzero(h[1:] != h[:-1]) + 1
        if held and held[-1].column("h")[-1].as_py() != h[0]:
            changes = np.concatenate([[0], changes])
        for c in changes.tolist():
            now = size + int(grown[c - 1] if c else 0) - taken
            if now >= block // 2:
                if c > begun:
                    held.append(batch.slice(begun, c - begun))
                yield told(held)
                held, size, begun, taken = [], 0, c, int(grown[c - 1] if c else 0)
        held.append(batch.slice(begun))
        size += int(grown[-1]) - taken
    if held:
        yield told(held)


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans: (k1, k2, n_removed, n_spans, kept, kept_sha256)."""
    for batch in pieces(batches):
        spans = batch.column("spans")
        flat = spans.flatten()
        a_all, b_all = (pc.struct_field(flat, i).to_numpy().astype(np.int64) for i in (0, 1))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(spans).to_numpy())])
        rows = []
        for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
            lo, hi, _ = united(a_all[offsets[i] : offsets[i + 1]], b_all[offsets[i] : offsets[i + 1]])
            kept = b"".join(text[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
            rows.append((len(text) - len(kept), len(lo), kept, hashlib.sha256(kept).hexdigest()))
        removed, n, kept, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=["k1", "k2", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept, kept_sha256)`` of every row of ``df``.

    Each byte of the UTF-8 text goes that a string of ``length`` bytes covers which starts anywhere else too, in this
    text or another row's; strings are judged on the input. ``kept`` holds the remaining bytes, null where nothing
    goes (a cut may lie inside a character); ``n_spans`` counts the maximal removed runs.

    A null text counts as empty; it and texts shorter than ``length`` keep all. Rows with equal texts (equal ids or
    null ids too) lose all of it, if it is long enough: equal texts are counted before anything is indexed, and one
    of them stands for all. Very long texts are hashed in stretches and indexed in blocks. An empty table has no
    rows; other columns are not read, and none of them clashes with the result.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    keyed = rows.withColumns({"k1": F.xxhash64(F.lit(1), "text"), "k2": F.xxhash64(F.lit(2), "text")})
    long = keyed.where(F.octet_length("text") >= length)

    long.select("k1", F.col("text").cast("binary").alias("text")).mapInArrow(lambda it: anchor_rows(it, length), ANCHOR_ROW).write.parquet(f"{folder}/anchors")
    found = spark.read.parquet(f"{folder}/anchors")
    # a hash that its task had once is repeated if another text has it, or another task had it twice
    once = found.where("not known").unionByName(found.where("known").select("h").distinct().withColumn("known", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("h")
    again = once.withColumns({"__any": F.max("known").over(w), "__lo": F.min("k").over(w), "__hi": F.max("k").over(w)})
    again = again.where("not known and (__any or __lo < __hi)").select("k", "first", "last")
    places = again.unionByName(found.where("known").select("k", "first", "last")).groupBy("k").agg(F.collect_set(F.struct("first", "last")).alias("at"))

    keys = keyed.select("id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    texts = keys.where(F.col("n_bytes") >= length).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.max("n_bytes").alias("n"))
    info = texts.join(places, F.col("k1") == F.col("k")).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "copies", "least", "at")
    one = long.join(info.hint("shuffle_hash"), (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")) & F.col("id").eqNullSafe(F.col("least")))
    one.select("k1", "k2", "copies", "at", F.col("text").cast("binary").alias("text")).write.parquet(f"{folder}/candidates")
    candidates = spark.read.parquet(f"{folder}/candidates")

    segments = candidates.select("k1", "k2", "text", "at").mapInArrow(lambda it: segment_rows(it, length), SEGMENT_ROW)
    spans = segments.repartition("h").sortWithinPartitions("h", "k1", "k2", "start").mapInArrow(lambda it: removed_rows(it, length, block), REMOVED_ROW)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    less = candidates.where("copies = 1").select("k1", "k2", "text").join(spans.hint("shuffle_hash"), ["k1", "k2"])
    less = less.mapInArrow(kept_rows, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")
    nothing = F.lit(b"")
    gone = texts.where("copies > 1").select("k1", "k2", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept"), F.sha2(nothing, 256).alias("kept_sha256"))
    changed = less.unionByName(gone)
    out = keys.join(changed, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")], "kept", F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
