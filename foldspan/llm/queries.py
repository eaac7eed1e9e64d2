"""The registered queries of the subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspan.llm.classlm import class_model_scores
from foldspan.llm.compression import compression_bands, fit_bands
from foldspan.llm.containment import contained_items
from foldspan.llm.langid import fit_languages, held_out, identified
from foldspan.llm.merkle import verified_rows
from foldspan.llm.mixing import mix_sources
from foldspan.llm.quality import fit_quality, scored
from foldspan.llm.runindex import remove_repeats
from foldspan.llm.sharding import shard_digests
from foldspan.llm.simhash import simhash_components
from foldspan.llm.urlrules import judged_urls, url_host
from foldspan.llm.whitening import whitened
from foldspan.llm.wrappers import extract_pages
from foldspan.session import table


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and repeat counts of every document, and whether its compression ratios lie inside the bands of its length, fitted on texts labelled good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bands = fit_bands(docs, labels=table(spark, sf_dir, "labels"))
    return compression_bands(docs, bands=bands).drop("text")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the stated rule that fits its URL, and the verdict: that of the rule, else of the mined rules."""
    return judged_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, with the size and target of its source."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_simhash_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id that it reaches over fingerprints four bits apart or less."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds 0.8 or more of the shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its host's wrapper; a null page has an empty one."""
    return extract_pages(table(spark, sf_dir, "pages"), url_host(F.col("url")))


def op7_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot, without its text."""
    return shard_digests(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; the documents of the held-out quarter teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; labels of the held-out quarter teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, labels=table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document by the class model and by the unigram base; those held out teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = class_model_scores(docs, ~held_out(F.col("doc_id"), 7))
    return scores.withColumn("held_out", held_out(F.col("doc_id"), 7)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes that strings of 400 bytes cover which start twice or more; digests of what is left."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, its proof in the manifest of all documents, and whether it still leads to the root."""
    return verified_rows(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of each embedding."""
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_compression_bands, op2_url_rules, op3_mixing, op4_simhash_tries, op5_contained_items, op6_wrappers, op7_shuffled_shards, op8_language, op9_quality, op10_class_lm, op11_run_index, op12_merkle, op13_whitening)
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"

MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, rn) AS k FROM s),
c AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS have,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM o),
first_free AS (SELECT k AS k0, CAST(have AS DOUBLE) / w AS level FROM c WHERE CAST(have AS DOUBLE) / w * weight <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT c.source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target FROM c LEFT JOIN first_free ON true),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole,
             CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
m AS (SELECT *, upto <= rest AS more FROM p),
g AS (SELECT *, rest - coalesce(sum(CASE WHEN more THEN size END) OVER (PARTITION BY source), 0) AS gap FROM m),
f AS (SELECT *, CASE WHEN NOT more AND abs(size - gap) < gap THEN row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT more AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), o, size) ELSE 0 END AS place FROM g)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN more OR place = 1 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f
"""

CONTAINED_SQL = rf"""
WITH shingled AS (
  SELECT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g
  FROM (SELECT 'doc' AS kind, doc_id AS id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        UNION ALL SELECT 'item', item_id, regexp_extract_all({_LOWER}, '{_WORDS}') FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
n AS (SELECT id, count(*) AS n FROM shingled WHERE kind = 'item' GROUP BY id),
hits AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k FROM shingled d JOIN shingled i ON d.g = i.g WHERE d.kind = 'doc' AND i.kind = 'item' GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_shared, CAST(k AS DOUBLE) / n AS containment
FROM hits JOIN n ON item_id = id WHERE k >= 0.8 * n
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_CHANGED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the decimal id: its bytes, each followed by eight steps of one bit.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: list_concat([ascii(c)::UBIGINT], [256::UBIGINT for _ in range(8)])))),
  lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END), 4294967295::UBIGINT)"""


def _climb(name: str, levels: int) -> str:
    """Tables ``name``1 and on above ``name``0 (tree, i, h, n), and the siblings of each level's nodes as ``name``0_way and on."""
    out = []
    for k in range(levels):
        run = "PARTITION BY tree, i // 16 ORDER BY i"
        out.append(f"""{name}{k}_way AS (SELECT tree, i, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k} WHERE n > {16**k}),
{name}{k + 1} AS (SELECT tree, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, any_value(n) AS n FROM {name}{k} WHERE n > {16**k} GROUP BY 1, 2)""")
    return ",\n".join(out)


def _fold(source: str, name: str, levels: int, at: str) -> str:
    """The rows of ``source`` with proof and folded root carried up the levels of ``name``, one subquery a level."""
    sql = source
    for k in range(levels):
        sql = f"""(SELECT x.* EXCLUDE (proof, f), proof || coalesce(w.before || w.after, '') AS proof, CASE WHEN w.before IS NULL THEN f ELSE sha256(w.before || f || w.after) END AS f
  FROM {sql} x LEFT JOIN {name}{k}_way w ON x.{at} // {16**k} = w.i AND {'x.source IS NOT DISTINCT FROM w.tree' if name == 't' else 'true'})"""
    return sql


#: Trees of up to 16 ** 5 leaves a source and 16 ** 3 sources.
MERKLE_SQL = f"""
WITH d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_CHANGED)} END AS changed FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM d),
t0 AS (SELECT source AS tree, rank AS i, leaf AS h, n FROM r),
{_climb('t', 5)},
last AS ({' UNION ALL '.join(f'SELECT tree, h FROM t{k} WHERE n {"= 1" if not k else f"> {16 ** (k - 1)} AND n <= {16**k}"}' for k in range(6))}),
g0 AS (SELECT NULL AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM last),
{_climb('g', 3)},
root AS ({' UNION ALL '.join(f'SELECT h AS root FROM g{k} WHERE n {"= 1" if not k else f"> {16 ** (k - 1)} AND n <= {16**k}"}' for k in range(4))}),
asked AS (SELECT r.*, g0.i AS g, g0.h AS subroot, '' AS proof, coalesce(changed, leaf) AS f FROM r JOIN g0 ON r.source IS NOT DISTINCT FROM g0.source)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM {_fold(_fold('asked', 't', 5, 'rank'), 'g', 3, 'g')} z CROSS JOIN root
"""

#: Hex digits of the bytes; each text is cut into stretches of 400 starts, so that taking a string out of it is short work.
RUNS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT r, n, j, substr(x, 800 * j + 1, 1598) AS c FROM (SELECT r, n, x, unnest(range(0, (n - 400) // 400 + 1)) AS j FROM d WHERE n >= 400)),
s AS (SELECT r, 400 * j + k AS i, md5(substr(c, 2 * k + 1, 800)) AS m FROM (SELECT *, unnest(range(0, least(400, n - 399 - 400 * j))) AS k FROM c)),
hit AS (SELECT r, i FROM s JOIN (SELECT m FROM s GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT r, i, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit)),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, k),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(x[2 * since + 1:2 * a], '' ORDER BY a) || any_value(x)[2 * max(b) + 1:] AS y FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLE_SQL = {"op3_mixing": MIXING_SQL, "op5_contained_items": CONTAINED_SQL, "op11_run_index": RUNS_SQL, "op12_merkle": MERKLE_SQL}
