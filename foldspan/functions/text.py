"""Text features as column expressions; dictionaries, markers and the sentence end are parameters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.functions.rows import safe_div


#: Texts that are Python strings at once; an Arrow batch has up to 10,000.
NFKC_ROWS = 64


def _nfkc(t: pa.Array) -> pa.Array:
    """NFKC a few texts at a time: more of them as Python strings weigh several times what Arrow holds."""
    one = lambda x: None if x is None else unicodedata.normalize("NFKC", x)
    parts = (pa.array([one(x) for x in t.slice(i, NFKC_ROWS).to_pylist()], pa.string()) for i in range(0, len(t), NFKC_ROWS))
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def nfkc(c: Column) -> Column:
    """Unicode normalisation form NFKC, in Arrow batches; Spark has no built-in."""
    return F.arrow_udf(_nfkc, "string")(c)


def squeezed(c: Column, mask_digits: bool = True, compatible: bool = False) -> Column:
    """Digits to 0, white space to one space, trimmed; ``compatible`` applies NFKC first. Null is empty."""
    c = F.coalesce(c, F.lit(""))
    c = nfkc(c) if compatible else c
    c = F.regexp_replace(c, "[0-9]+", "0") if mask_digits else c
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def squeezed_paragraphs(c: Column, mask_digits: bool = True) -> Column:
    """As ``squeezed``, inside each paragraph; paragraph breaks stay."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\n[ \t]*\n"), lambda p: squeezed(p, mask_digits))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def sentences(c: Column, end: str = "。") -> Column:
    """Sentences with their end mark."""
    parts = F.split(F.coalesce(c, F.lit("")), f"(?<={re.escape(end)})")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))), lambda s: s != "")


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(re.escape(p) for p in patterns)


def has_any(c: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(c.rlike(any_of(patterns)), F.lit(False)).cast("int")


def count_literals(c: Column, patterns: Sequence[str]) -> Column:
    """Non-overlapping occurrences of each literal, summed."""
    c, out = F.coalesce(c, F.lit("")), F.lit(0)
    for p in patterns:
        out = out + ((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return out


def tense_of(s: Column, future: Sequence[str], current: Sequence[str]) -> Column:
    f, c = s.rlike(any_of(future)), s.rlike(any_of(current))
    return F.when(f & ~c, "future").when(c & ~f, "current").otherwise("both")


def tense_parts(c: Column, future: Sequence[str], current: Sequence[str], end: str = "。") -> dict[str, Column]:
    """Sentences about the present and about the future; those of both or neither are in both."""
    s = sentences(c, end)
    kept = lambda kind: F.array_join(F.filter(s, lambda x: tense_of(x, future, current).isin(kind, "both")), " ")
    return {"current_text": kept("current"), "future_text": kept("future")}


def future_carried(c: Column, future: Sequence[str], current: Sequence[str], end: str = "。") -> Column:
    """Sentences about the future, and unmarked ones after the first of them."""

    def step(kept: Column, s: Column) -> Column:
        take = s.rlike(any_of(future)) | (~s.rlike(any_of(current)) & (F.size(kept) > 0))
        return F.when(take, F.concat(kept, F.array(s))).otherwise(kept)

    return F.array_join(F.aggregate(sentences(c, end), F.array().cast("array<string>"), step), " ")


def context_of(c: Column, keywords: Sequence[str], end: str = "。") -> Column:
    return F.array_join(F.filter(sentences(c, end), lambda s: s.rlike(any_of(keywords))), " ")


def share(a: Column, b: Column) -> Column:
    return F.coalesce(safe_div(a, b), F.lit(0.0))


def outlook_block(df: DataFrame, text: str, words: Mapping[str, Sequence[str]], future: Sequence[str], current: Sequence[str], end: str = "。") -> DataFrame:
    """``df`` with nine counts, five flags, two differences, three shares, three interactions of the groups
    cautious, expand, education and vendor in the whole text, its future part and its education sentences."""
    df = df.withColumns({"__ahead": future_carried(F.col(text), future, current, end), "__learn": context_of(F.col(text), words["education"], end)})
    c, ahead, learn = F.col(text), F.col("__ahead"), F.col("__learn")
    n = {f"{k}_count": count_literals(c, words[k]) for k in ("cautious", "expand", "education", "vendor")}
    n |= {f"future_{k}_count": count_literals(ahead, words[k]) for k in ("cautious", "expand", "education")}
    n |= {f"edu_{k}_count": count_literals(learn, words[k]) for k in ("cautious", "expand")}
    df, n = df.withColumns(n), {k: F.col(k) for k in n}
    some = lambda k: (n[k] > 0)
    flags = {f"has_{k}": some(f"{k}_count").cast("int") for k in ("cautious", "future_cautious", "education", "future_education", "vendor")}
    both = {f"{a}_x_{b}": (some(f"{a}_count") & some(f"{b}_count")).cast("int") for a, b in (("education", "expand"), ("education", "cautious"), ("vendor", "education"))}
    kana = F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([ァ-ヶー])"), F.lit(1)))
    shares = {"future_text_ratio": share(F.length(ahead), F.length(c)), "education_text_ratio": share(F.length(learn), F.length(c)), "katakana_ratio": share(kana, F.length(c))}
    less = {"expand_minus_cautious": n["expand_count"] - n["cautious_count"], "future_expand_minus_cautious": n["future_expand_count"] - n["future_cautious_count"]}
    return df.withColumns({**flags, **less, **shares, **both}).drop("__ahead", "__learn")


def overview_block(df: DataFrame, text: str, words: Mapping[str, Sequence[str]], industry: Column | None = None, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with counts and flags of the groups digital, service, rd, finance, manufacturing, low, physical; their interactions;
    and three conditioned on patterns ``kinds`` (information, finance, manufacturing) of the industry."""
    n = {f"{k}_count": count_literals(F.col(text), words[k]) for k in ("digital", "service", "rd", "finance", "manufacturing", "low", "physical")}
    df, n = df.withColumns(n), {k: F.col(k) for k in n}
    some = {k: n[f"{k}_count"] > 0 for k in ("digital", "service", "rd", "finance", "low", "physical")}
    out = {f"has_{k}": v.cast("int") for k, v in some.items()}
    out["digital_minus_low"] = n["digital_count"] + n["service_count"] + n["rd_count"] + n["finance_count"] - n["low_count"]
    for a, b in (("digital", "service"), ("digital", "rd"), ("finance", "digital"), ("low", "physical")):
        out[f"{a}_x_{b}"] = (some[a] & some[b]).cast("int")
    if industry is not None:
        of = {k: F.coalesce(industry.rlike(p), F.lit(False)) for k, p in kinds.items()}
        out["digital_x_non_info"] = (some["digital"] & ~of["information"]).cast("int")
        out["finance_x_non_finance"] = (some["finance"] & ~of["finance"]).cast("int")
        out["rd_x_manufacturing"] = (some["rd"] & of["manufacturing"]).cast("int")
    return df.withColumns(out)


def top_flags(c: Column, groups: Sequence[tuple[str, Sequence[str]]], prefix: str = "top", total: str | None = None) -> dict[str, Column]:
    """A flag for each keyword group, and how many of them are set."""
    out = {f"{prefix}_{name}": has_any(c, words) for name, words in groups}
    count = sum(list(out.values())[1:], list(out.values())[0])
    return out | ({total: count} if total else {})


def high_low_flags(c: Column, high: Sequence[tuple], low: Sequence[tuple]) -> dict[str, Column]:
    h, w = top_flags(c, high, "high", "high_count"), top_flags(c, low, "low", "low_count")
    return {**h, **w, "high_minus_low": h["high_count"] - w["low_count"]}


def chart_flags(c: Column, groups: Mapping[str, Sequence[str]], products: Sequence[tuple[str, str]]) -> dict[str, Column]:
    flags = {f"has_{k}": has_any(c, v) for k, v in groups.items()}
    return flags | {f"{a}_x_{b}": flags[f"has_{a}"] * flags[f"has_{b}"] for a, b in products}


def name_block(c: Column, legal_forms: Sequence[str], first: str, second: str, token: str) -> dict[str, Column]:
    """Name without legal form: shares of two character classes, its length, a token flag."""
    core = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), any_of(legal_forms), ""))
    count = lambda cls: F.size(F.regexp_extract_all(core, F.lit(f"({cls})"), F.lit(1)))
    return {"first_ratio": share(count(first), F.length(core)), "second_ratio": share(count(second), F.length(core)), "name_length": F.length(core), "has_token": F.contains(core, F.lit(token)).cast("int")}


def family_hits(c: Column, families: Mapping[str, str]) -> Column:
    """Names of the families whose pattern occurs."""
    c = F.coalesce(c, F.lit(""))
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in families.items()]), lambda x: x.isNotNull())


def laplace_share(a: Column, b: Column) -> Column:
    return (F.size(a) + 1.0) / (F.size(a) + F.size(b) + 2.0)


def channel_score(c: Column) -> Column:
    t = F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    b, k = F.contains(t, F.lit("BTOB")), F.contains(t, F.lit("BTOC"))
    return F.when(b & ~k, 1.0).when(b & k, 0.5).when(k, 0.0).otherwise(0.5)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """``df`` with ``value`` of its ``key`` in the table (one row a key), or the default."""
    t = table.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return df.join(t, F.col(key) == F.col("__k"), "left").withColumn(value, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def workforce_axes(df: DataFrame, chart: str, overview: str, industry_score: Column, channel: str, employees: str, knowledge: Mapping[str, str], field: Mapping[str, str]) -> DataFrame:
    """Share of knowledge work in the chart, of the business, breadth of both, and the scale of who could be trained;
    with the logarithm of the employees and their share as the parents of that product."""
    df = df.withColumns({"__ck": family_hits(F.upper(chart), knowledge), "__cf": family_hits(F.upper(chart), field), "__ok": family_hits(F.upper(overview), knowledge), "__of": family_hits(F.upper(overview), field)})
    df = df.withColumns({
        "org_share": laplace_share(F.col("__ck"), F.col("__cf")),
        "business_share": (laplace_share(F.col("__ok"), F.col("__of")) + industry_score + channel_score(F.col(channel))) / 3.0,
        "breadth": F.size(F.array_union("__ck", "__ok")) / float(len(knowledge)),
        "log_heads": F.log1p(F.greatest(F.coalesce(F.col(employees).cast("double"), F.lit(0.0)), F.lit(0.0))),
    }).drop("__ck", "__cf", "__ok", "__of")
    df = df.withColumn("target_scale", F.col("log_heads") * (F.col("org_share") + F.col("business_share")) / 2.0)
    return df.withColumn("target_share", F.coalesce(safe_div("target_scale", F.when(F.col("log_heads") != 0, F.col("log_heads"))), F.lit(0.5)))


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """All character n-grams, repeats included. A text becomes its characters once, as a substring looks for its place from the start."""

    def some(chars: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) >= n, made).otherwise(F.array().cast("array<string>"))

    chars = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?s)."), F.lit(0))
    # the characters are the argument of a function, so that they are found once for all lengths
    return F.flatten(F.transform(F.array(chars), lambda x: F.concat(*[some(x, n) for n in range(low, high + 1)])))


def word_char_ngrams(c: Column, low: int, high: int) -> Column:
    """Character n-grams inside words that are padded by a space on each side."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: char_ngrams(F.concat(F.lit(" "), w, F.lit(" ")), low, high)))


def term_table(df: DataFrame, id_col: str, col: str, terms: Callable[[Column], Column]) -> DataFrame:
    """``(term, n, df)``: how often a term occurs, and the number of ids, nulls aside, that have it.

    An id's texts come together first, and its terms count where they are: only terms are aggregated, not pairs of term
    and id.
    """
    rows = df.groupBy(id_col).agg(F.collect_list(F.coalesce(col, F.lit(""))).alias("__t"))
    rows = rows.select(F.col(id_col).isNotNull().cast("long").alias("__one"), F.flatten(F.transform("__t", terms)).alias("__t"))
    each = lambda values, n, ids: F.transform(values, lambda x: F.struct(x.alias("term"), n.alias("n"), ids.alias("df")))
    long = rows.select(F.explode(F.concat(each(F.col("__t"), F.lit(1).cast("long"), F.lit(0).cast("long")), each(F.array_distinct("__t"), F.lit(0).cast("long"), F.col("__one")))).alias("x"))
    return long.groupBy("x.term").agg(F.sum("x.n").alias("n"), F.sum("x.df").alias("df"))


def word_ngrams(c: Column, low: int = 1, high: int = 2, pattern: str = r"([\p{L}\p{N}]{2,})") -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(1))

    def some(words: Column, n: int) -> Column:
        out = words
        for k in range(1, n):
            out = F.zip_with(out, F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(out, lambda x: x.isNotNull())

    # the words are the argument of a function, so that they are found once for all shifts
    return F.flatten(F.transform(F.array(found), lambda words: F.concat(*[some(words, n) for n in range(low, high + 1)])))


def clipped(c: Column, width: int, tail: bool = False) -> Column:
    """The head or the tail of a text, with an ellipsis where something is cut."""
    c = F.coalesce(c, F.lit(""))
    cut = F.concat(F.lit("…"), F.right(c, F.lit(width - 1))) if tail else F.concat(F.left(c, F.lit(width - 1)), F.lit("…"))
    return F.when(F.length(c) <= width, c).otherwise(cut)


def head_tail(tokens: Column, most: int, head: int) -> Column:
    """The first ``head`` and the last ``most - head`` tokens of longer lists."""
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, head), F.slice(tokens, -(most - head), most - head)))


def chunks(tokens: Column, width: int, stride: int) -> Column:
    """Overlapping slices that end with the first one to reach the last token."""
    n = F.greatest(F.ceil((F.size(tokens) - width) / stride), F.lit(0)).cast("int")
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(tokens, k * stride + 1, F.lit(width)))).otherwise(F.array().cast("array<array<string>>"))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n[ \t]*\n"), lambda p: F.trim(p)), lambda p: p != "")


def last_paragraph(c: Column) -> Column:
    return F.try_element_at(paragraphs(c), F.lit(-1))
