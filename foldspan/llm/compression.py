"""Quality rules by compression bands.

Zstandard ratios (bytes over compressed bytes) of the whole text and of fixed chunks must lie inside limits
that depend on the length: above them a text repeats itself or uses few kinds of characters, below them it is noise.
The limits of a length are learned from texts that are labelled good; lengths with too few of those have stated ones.

Texts are taken whole at any length. Null and wordless texts are not kept. Equal rows are judged alike; a ratio equal
to a limit is inside. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.llm.textops import SPACE, coded, mix64, segment_sums, split_words
from foldspan.operators.ranks import exact_percentiles
from foldspan.plans.lineage import cut

#: (bytes from, lowest ratio, highest ratio) where nothing was learned; short texts compress less, as headers and first uses weigh more.
BANDS = ((0, 0.0, 2.0), (64, 0.6, 2.0), (128, 0.9, 2.4), (512, 1.2, 2.8), (2048, 1.4, 3.2), (8192, 1.5, 3.6), (65536, 1.5, 4.5))
CHUNK_BYTES, LEVEL, WINDOW = 4096, 3, 5
#: Bands of each doubling of the length, the share of good texts outside learned limits on each side, how far beyond
#: those the limits are set, and the good texts that a band must have.
OCTAVE, TAIL, MARGIN, FEWEST = 2, 0.005, 0.02, 40
SYMBOLS = "#*$%&|<>"
FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_bytes bigint, "
    "ratio double, chunk_ratio_min double, chunk_ratio_max double, band_failed boolean, base_failed boolean, kept boolean"
)


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which the text has twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mix64(codes[k : k + n] + k)
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[inverse] > 1)
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def chunks(raw: bytes, size: int) -> list[bytes]:
    """The pieces of ``size`` bytes; a short last piece belongs to the one before it."""
    cuts = list(range(0, max(1, len(raw) - size // 2), size))
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)] if raw else []


def judged(text: pa.Array, bands: Sequence[tuple], chunk: int, level: int) -> pa.Array:
    zstd = zstandard.ZstdCompressor(level=level)
    floors = np.array([b[0] for b in bands])
    ratio = lambda b: len(b) / len(zstd.compress(b))
    limits = lambda n: bands[max(0, int(np.searchsorted(floors, n, "right")) - 1)][1:]
    bounds, flat = split_words(text)
    codes, _ = coded(flat)
    chars = segment_sums(pc.utf8_length(flat).to_numpy(zero_copy_only=False), bounds)
    rows = []
    for i, t in enumerate(text.to_pylist()):
        t = t or ""
        raw, n = t.encode("utf-8", "surrogatepass"), int(bounds[i + 1] - bounds[i])
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        repeats = repeated_words(codes[bounds[i] : bounds[i + 1]])
        parts = chunks(raw, chunk)
        whole = ratio(raw) if raw else 0.0
        each = [whole] if len(parts) == 1 else [ratio(p) for p in parts]
        inside = bool(raw) and limits(len(raw))[0] <= whole <= limits(len(raw))[1] and all(limits(len(p))[0] <= r <= limits(len(p))[1] for p, r in zip(parts, each, strict=True))
        base = n < 10 or 100 * repeats > 20 * n
        rows.append((n, int(chars[i]), sum(t.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeats, len(raw), whole, min(each, default=0.0), max(each, default=0.0), not inside, base, inside and not base))
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [{"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]] for f in FIELDS.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def compression_verdict(text: Column, bands: Sequence[tuple] = BANDS, chunk: int = CHUNK_BYTES, level: int = LEVEL) -> Column:
    """A struct of figures and the verdict of a text column."""
    return F.arrow_udf(lambda t: judged(t, bands, chunk, level), FIELDS)(text.cast("string"))


def _sizes_and_ratios(text: pa.Array, chunk: int, level: int) -> pa.Array:
    """For each text the sizes and ratios of the whole and, if there are more than one, of its chunks."""
    zstd, out = zstandard.ZstdCompressor(level=level), []
    for t in text.to_pylist():
        raw = (t or "").encode("utf-8", "surrogatepass")
        parts = chunks(raw, chunk)
        out.append([{"size": len(p), "ratio": len(p) / len(zstd.compress(p))} for p in ([raw, *parts] if len(parts) > 1 else parts)])
    return pa.array(out, pa.list_(pa.struct([("size", pa.int64()), ("ratio", pa.float64())])))


def fit_bands(good: DataFrame, text_col: str = "text", stated: Sequence[tuple] = BANDS, chunk: int = CHUNK_BYTES, level: int = LEVEL, labels: DataFrame | None = None, id_col: str = "doc_id", label: str = "quality") -> list[tuple[int, float, float]]:
    """Limits by length from texts that are known to be good, in the form of ``BANDS``.

    Wholes and chunks of one length share a band, as they share its limits. The limits are the outer percentiles of
    the band's ratios, set wider by a margin; where a band has too few texts the stated limits of its length hold. The
    percentiles are exact and of all texts; only one row a band reaches the driver. With ``labels`` all texts are
    measured, and the figures of those labelled 1 are kept: figures meet labels, so that no text is shuffled.
    """
    measured = F.arrow_udf(lambda t: _sizes_and_ratios(t, chunk, level), "array<struct<size:bigint,ratio:double>>")(F.col(text_col).cast("string"))
    if labels is None:
        parts = good.select(measured.alias("parts"))
    else:
        parts = good.select(F.col(id_col).alias("__id"), measured.alias("parts")).join(_good_ids(labels, id_col, label), F.col("__id") == F.col("__good"))
    parts = cut(parts.select(F.explode("parts").alias("p")).select(F.floor(OCTAVE * F.log2("p.size")).cast("int").alias("band"), "p.ratio"))
    enough = parts.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)
    learned = {r["band"]: r["q"] for r in exact_percentiles(parts, ["band"], "ratio", [TAIL, 1 - TAIL], "q").join(enough, "band").collect()}
    starts = {int(np.ceil(2 ** (b / OCTAVE))): q for b, q in learned.items()}
    ends = {int(np.ceil(2 ** ((b + 1) / OCTAVE))) for b in learned}
    floors = sorted({b[0] for b in stated} | set(starts) | ends)
    out, limits = [], None
    for at in floors:
        inside = [(s, q) for s, q in starts.items() if s <= at and at < int(np.ceil(2 ** ((np.floor(OCTAVE * np.log2(s)) + 1) / OCTAVE)))]
        limits = (inside[0][1][0] * (1 - MARGIN), inside[0][1][1] * (1 + MARGIN)) if inside else next(b[1:] for b in reversed(stated) if b[0] <= at)
        out.append((at, *limits))
    return out


def _good_ids(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """``__good``: each id that is labelled 1, once; null ids and labels teach nothing."""
    return labels.where(F.col(label) == 1).select(F.col(id_col).alias("__good")).where("__good is not null").distinct()


def labelled_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int | None = None) -> DataFrame:
    """The texts of ``docs`` whose label is 1; with ``sample`` at most about so many, those with the smallest hashes of their ids."""
    good = _good_ids(labels, id_col, label)
    if sample is not None and (n := good.count()) > sample:
        good = good.where(F.pmod(F.xxhash64("__good"), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(good, F.col("__id") == F.col("__good"), "left_semi").select("text")


def compression_bands(df: DataFrame, text_col: str = "text", bands: Sequence[tuple] = BANDS, chunk: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """``df`` with its word counts, compression ratios and ``kept``.

    One pass without a shuffle. A null or empty text has zeros everywhere and is not kept. Columns of
    ``df`` that have the name of a result are replaced; repeated rows are judged alike; an empty table stays so.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    judged_df = df.withColumn("__judged", compression_verdict(F.col(text_col), bands, chunk, level))
    return judged_df.withColumns({n: F.col("__judged")[n] for n in names if n != text_col}).drop("__judged")
