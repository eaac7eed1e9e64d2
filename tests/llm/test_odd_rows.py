"""Nulls, empty and long texts, repeats, empty tables and clashing names, for the operators that other files do not try."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspan.llm.langid import fit_languages, ftrl, identified, softmax, temperature
from foldspan.llm.quality import fit_quality, scored, train_vectors
from foldspan.llm.sharding import shard_digests
from foldspan.llm.wrappers import aligned, blocks, extract_pages, folded, matches

SCHEMA = "doc_id long, text string, lang string, score string"
GOOD = "der Hund und die Katze sehen ein Haus"
OTHER = "the dog and the cat will see this house"


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(i, f"{GOOD} {i}" if i % 2 else f"{OTHER} {i}", "de" if i % 2 else "en") for i in range(60)]
    texts += [(100, None, "en"), (101, "", "en"), (102, " \n", None), (103, "123 ½ ² ①", "en"), (None, OTHER, None), (1, GOOD, None), (1, GOOD, None), (104, (GOOD + " ") * 20_000, None)]
    return spark.createDataFrame([(*t, "clash") for t in texts], SCHEMA)


def test_languages(spark, rows):
    model = fit_languages(rows.where("doc_id < 60"))
    got = identified(rows, model).collect()
    assert len(got) == rows.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[k] for k in (100, 101, 102, 103, None, 1, 104)] == ["und", "und", "und", "und", "en", "de", "de"]
    assert identified(rows.where("false"), model).count() == 0
    nothing = identified(rows, fit_languages(rows.where("false"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_ftrl_by_plain_steps():
    rng = np.random.default_rng(1)
    examples = [(np.sort(rng.choice(6, 3, replace=False)), rng.normal(size=3), int(rng.integers(0, 2))) for _ in range(8)]
    a, b, l1, l2 = 0.5, 1.0, 0.02, 1e-4
    z, n = np.zeros((2, 6)), np.zeros((2, 6))
    weight = lambda c, f: 0.0 if abs(z[c, f]) <= l1 else -(z[c, f] - np.sign(z[c, f]) * l1) / ((b + n[c, f] ** 0.5) / a + l2)
    order = np.random.default_rng(5)
    for _ in range(2):
        for k in order.permutation(8):
            ids, x, y = examples[k]
            w = np.array([[weight(c, f) for f in ids] for c in range(2)])
            p = softmax(w @ x)
            for c in range(2):
                for f, v, old in zip(ids, x, w[c], strict=True):
                    g = (p[c] - (c == y)) * v
                    z[c, f] += g - ((n[c, f] + g * g) ** 0.5 - n[c, f] ** 0.5) / a * old
                    n[c, f] += g * g
    assert np.allclose(ftrl(examples, 2, 6, a, b, l1, l2, 2), [[weight(c, f) for f in range(6)] for c in range(2)])


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(2)
    logits, y = rng.normal(0, 4, (3, 200)), rng.integers(0, 3, 200)
    y[:150] = logits.argmax(axis=0)[:150]
    loss = lambda t: -np.log(softmax(logits / t)[y, np.arange(200)]).mean()
    t = temperature(logits, y)
    assert all(loss(t) <= loss(t * f) + 1e-9 for f in (0.8, 0.95, 1.05, 1.3))


def test_one_training_step_follows_the_gradient():
    ids, share = np.array([1, 3]), np.array([0.25, 0.75])
    before = np.random.default_rng(3)
    e = before.uniform(-1 / 4, 1 / 4, (1 << 3, 4))
    w = before.normal(0, 1 / 4, (2, 4))
    after_e, after_w, after_b = train_vectors([(ids, share, 1)], 2, bits=3, dim=4, epochs=1, rate=0.1, seed=3)
    loss = lambda e, w, b: -np.log(softmax(w @ (share @ e[ids]) + b)[1])
    for c in range(2):  # the bias moves by the rate times the numeric gradient
        d = np.zeros(2)
        d[c] = 1e-6
        g = (loss(e, w, d) - loss(e, w, -d)) / 2e-6
        assert abs(after_b[c] + 0.1 * g) < 1e-6
    assert loss(after_e, after_w, after_b) < loss(e, w, np.zeros(2)) and (after_e[[0, 2, 4, 5, 6, 7]] == e[[0, 2, 4, 5, 6, 7]]).all()


def test_quality(spark, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (104, 1)], "doc_id long, quality int")
    model = fit_quality(rows, labels=labels)
    got = scored(rows, model).collect()
    assert len(got) == rows.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (100, 101, 102)}) == 1
    again = fit_quality(rows.repartition(5), labels=labels.repartition(3))
    assert np.array_equal(model.weight, again.weight) and model.bias == again.bias
    assert scored(rows.where("false"), model).count() == 0
    one = fit_quality(rows, labels=labels.where("quality = 1"))
    assert {round(r["score"], 6) for r in scored(rows, one).collect()} == {round(31.5 / 32, 6)} or len({r["score"] for r in scored(rows, one).collect()}) == 1


def test_shards(spark, rows):
    given = rows.select("doc_id", "text", "lang", F.lit("clash").alias("shard"))
    got = shard_digests(given).collect()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 1, -1 if r["text"] is None else zlib.crc32(r["text"].encode())) for r in rows.collect())
    assert sorted((r["doc_id"] or -1, r["size"], -1 if r["text_crc32"] is None else r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_digests(given.where("false")).count() == 0


def test_pages(spark):
    story = lambda i: "".join(f"<p>part {k} of story {i} that goes on and on</p>" for k in range(1 + i % 4))
    plain = lambda i: "\n\n".join(f"part {k} of story {i} that goes on and on" for k in range(1 + i % 4))
    frame = "<html><head><script>var a='<p>x</p>'</script><style>p{{}}</style></head><body><div class=top><a href=/>home</a> <a href=/b>b</a></div><div><div>Same words on every page</div><section>{}</section></div><div>(c) all pages</div></body></html>"
    pages = [(i, f"http://a/{i}", frame.format(story(i))) for i in range(12)]
    odd = [
        (100, None, None),
        (101, "http://b", ""),
        (102, "http://c", "<article><p data-x=it's>first</p><p>second</p></article><p>it's</p>"),
        (103, "http://d", "<p>a</p><![CDATA[hello world"),
        (104, "http://e", "<article>" + "".join(f"<p class=c{k}>x{k}</p>" for k in range(20_000)) + "</article>"),
        (3, "http://a/3", pages[3][2]),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages + odd], "page_id long, url string, html string, text string")
    got = extract_pages(df, F.regexp_extract("url", "http://([^/]*)", 1)).collect()
    assert len(got) == len(pages) + len(odd) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(12):
        assert by[i] == plain(i)
    assert (by[100], by[101]) == ("", "") and by[102].startswith("first\n\nsecond") and "hello world" in by[103] and by[104].count("\n\n") == 19_999
    assert extract_pages(df.where("false"), F.col("url")).count() == 0


def test_alignments_fit_both_sides():
    def expression(nodes):
        return "".join(f"(?:{expression(n[1])}){n[0]}" if isinstance(n, list) else f"{n};" for n in nodes)

    rng = np.random.default_rng(4)
    for _ in range(400):
        a, b = ([f"k{x}" for x in rng.integers(0, 6, rng.integers(0, 12))] for _ in range(2))
        found = matches(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                longest[i + 1][j + 1] = longest[i][j] + 1 if a[i] == b[j] else max(longest[i][j + 1], longest[i + 1][j])
        assert len(found) == longest[-1][-1]
    for n in (2, 3, 5):
        for _ in range(40):
            first, *rest = streams = [[f"k{x}" for x in rng.integers(0, 5, rng.integers(1, 9))] for _ in range(n)]
            wrapper = folded(first)
            for s in rest:
                wrapper = aligned(wrapper, folded(s))
            assert all(re.fullmatch(expression(wrapper), "".join(f"{t};" for t in s)) for s in streams)
    assert list(blocks("<p a=\"x>y\" b='q>r' c=it's>t</p>")) == [("p", "t", 0)]
