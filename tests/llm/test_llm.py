"""The training-data operators against brute force, exact truths and held-out labels."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from foldspan.llm import queries as Q
from foldspan.llm.compression import compression_bands
from foldspan.llm.containment import contained_items
from foldspan.llm.mixing import capped_targets, min_cost_flow, mix_sources
from foldspan.llm.nearcopies import drop_similar
from foldspan.llm.sharding import communication_matrix, shuffled_shards
from foldspan.llm.simhash import fingerprint, hamming_links, simhash_components
from foldspan.llm.urlrules import judged_urls
from foldspan.llm.wrappers import extract_pages

ODD = [(1, "a b c d e f", "x"), (2, None, None), (3, "", "x"), (None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (4, " \t\n", None), (5, "word " * 30000, "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumn("score", F.lit("clash"))


def components(prints, bits):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [4096, 8])
def test_tries_find_every_component(spark, limit):
    rng = np.random.default_rng(1)
    values = set()
    for c in rng.integers(-(2**62), 2**62, 12).tolist():
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            v = (c & (2**64 - 1)) ^ sum(1 << int(f) for f in flips)
            values.add(v - 2**64 if v >= 2**63 else v)
    prints = dict(enumerate(sorted(values)))
    edges = hamming_links(spark.createDataFrame(list(prints.items()), "node long, bits long"), "node", "bits", 4, limit).collect()
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        x, y = sorted((find(e["a"]), find(e["b"])))
        root[y] = x
    assert {i: find(i) for i in prints} == components(prints, 4)


def test_simhash_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r["doc_id"]: fingerprint(r["text"], 4, 42) for r in docs.collect()}
    got = {r["doc_id"]: r for r in simhash_components(docs).collect()}
    want = components(prints, 4)
    assert {k: v["component_id"] for k, v in got.items()} == want
    # the fingerprint again by the built-in XXH64, which has this seed
    words = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size("w") - 3, F.lit(1))
    hashes = docs.select("doc_id", words.alias("w")).where("size(w) > 0").select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("i"), "w")
    hashes = hashes.select("doc_id", "n", F.xxhash64(F.array_join(F.slice("w", F.col("i"), F.lit(4)), " ")).alias("h"))
    bits = [(2 * F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))) > F.first("n")).cast("string").alias(f"b{b}") for b in range(64)]
    for r in hashes.groupBy("doc_id").agg(*bits).collect():
        assert sum((r[f"b{b}"] == "true") << b for b in range(64)) == prints[r["doc_id"]] & (2**64 - 1)
    assert all(v["fingerprint"] == f"{prints[k] & (2**64 - 1):016x}" for k, v in got.items())


def test_simhash_odd_rows(odd):
    got = simhash_components(odd).collect()
    assert len(got) == len(ODD)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["fingerprint"] == "0" * 16} == {(2, 2), (3, 2), (4, 2)}
    assert simhash_components(odd.where("false")).count() == 0


def test_near_copies_by_exact_similarity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    docs, sets = [], {}
    for g in range(12):
        base = rng.choice(words, 120).tolist()
        for c in range(6):
            text = list(base)
            for at in rng.choice(120, c, replace=False):  # c changed words leave a similarity of about 1, 0.92, 0.84, 0.77 ...
                text[at] = f"x{rng.integers(1 << 40)}"
            docs.append((len(docs), " ".join(text)))
    docs += [(None, docs[0][1]), (3, docs[3][1]), (500, ""), (501, None), (502, "two words"), (None, "Two words")]
    for i, t in docs:
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    got = sorted(r["doc_id"] for r in drop_similar(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted({*root.values(), 500, 501}) and len(got) > 16


def test_compression(spark, odd, sf_dir):
    got = compression_bands(odd).collect()
    assert [r["kept"] for r in got if not (r["text"] or "").strip()] == [False] * 3
    long = next(r for r in got if r["doc_id"] == 5)
    assert (long["n_words"], long["n_repeat_words"], long["base_failed"]) == (30000, 30000, True)
    z = zstandard.ZstdCompressor(level=3)
    for r in compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet")).limit(60).collect():
        words = r["text"].encode().split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        times = Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
        lines = [x for x in r["text"].split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), len(cover), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert math.isclose(r["ratio"], len(r["text"].encode()) / len(z.compress(r["text"].encode())))


def test_containment(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words)
    docs = [(1, "x " * 500 + item.upper() + " y" * 500), (2, " ".join(words[:30])), (3, None), (4, " ".join(words[:25] + ["zz"] + words[25:])), (None, item), (5, "q")]
    items = [(7, item), (8, None), (9, "q"), (10, "")]
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 7): 56, (4, 7): 52, (5, 9): 1}


def test_flow_prefers_fresh_words():
    assert capped_targets([10, 100], [5, 1], 3) == [30.0, 80.0]
    flow = min_cost_flow([10, 10], [[0, 1], [1]], [15, 5], (0, 1, 3))
    assert flow == [{0: 15}, {1: 5}]


def test_mixing(spark, odd):
    got = mix_sources(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mix_sources(odd.where("false")).count() == 0
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("source"))
    both = mix_sources(rows)
    assert both.count() == 400 and sorted(map(str, both.collect())) == sorted(map(str, mix_sources(rows.repartition(7)).collect()))


def test_sharding(spark, odd):
    m = np.array(communication_matrix([5, 0, 17, 40], 8, 1))
    assert m.sum(axis=1).tolist() == [5, 0, 17, 40] and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    got = shuffled_shards(spark.range(1003).withColumn("shard", F.lit("clash")), 8, ["id"], partition_rows=50).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 1003 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert shuffled_shards(odd).count() == len(ODD) and shuffled_shards(odd.where("false")).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.org/en/12?q", "http://example.org/es/1", "https://x.com/de/1#t", "https://com/fr/", "http://a.net/de/3", None, "no url"]
    got = {r["page_id"]: r for r in judged_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(7)] == ["example.org/en/1", "example.org/es/", "com/de/", "com/fr/", None, None, None]
    assert (got[0]["host"], got[0]["path"], got[5]["host"], got[6]["path"]) == ("a.example.org", "/en/12", "", "")
    many = [(i, f"http://h{i % 9}.com/{'de' if i % 2 else 'fr'}/{i}") for i in range(200)] + [(900, "http://q.net/de/5"), (901, "http://q.net/fr/5")]
    got = {r["page_id"]: r for r in judged_urls(spark.createDataFrame(many, "page_id long, url string")).collect()}
    assert (got[900]["verdict"], got[900]["rule_tokens"], got[901]["verdict"]) == ("block", "path1:de", "allow")


def test_wrappers(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div id='c'><h1>T{0}</h1><p>one &amp; {0}<br>more</p><p>two {0}<div class=comments>says</div></div><footer>f</footer></body></html>"
    rows = [(i, "http://h", page.format(i)) for i in range(5)] + [(9, "http://h", None), (10, None, "<article>a<aside>b</aside><p>c</article>x")]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), F.col("url")).collect()}
    assert got[3] == "T3\n\none & 3 more\n\ntwo 3" and got[9] == "" and got[10] == "a\n\nc"


def test_wrapper_slots_decide_with_an_article(spark):
    page = "<body class='no-sidebar'><article><p>Sign up now<h1>Title {0}</h1><p>first {0}</p><p>second {0}</p></article><div>all the same</div></body>"
    other = "<body><article><p>teaser</article><div class=story><p>long story of page {0} that goes on</p><p>more of {0} and on</p></div></body>"
    rows = [(i, "a", page.format(i)) for i in range(4)] + [(10 + i, "b", other.format(i)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), F.col("url")).collect()}
    assert got[2] == "Title 2\n\nfirst 2\n\nsecond 2" and got[12] == "long story of page 2 that goes on\n\nmore of 2 and on"


def test_language_held_out(spark):
    got = Q.op8_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_quality_held_out(spark):
    got = Q.op9_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.9


def test_class_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().translate(lower).split(), None] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    model = base = 0.0
    for r in Q.op10_class_lm(spark, sf_dir).collect():
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        if r["held_out"]:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base
