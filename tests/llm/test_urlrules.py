"""Stated and mined URL rules against plain enumeration."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from foldspan.llm.urlrules import RULES, frequent_tokens, judged_urls, match_rules, mine_rules, url_tokens

SCHEMA = "page_id long, url string, host string, rule string"


def plain_rule(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [r for r, _ in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=lambda r: (len(r), r), default=None)


def random_urls(n, seed):
    rng = random.Random(seed)
    hosts = ["A.example.org", "example.org", "x.com", "com", "badexample.org", "b.net", "org", "example.org:80"]
    return [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'de', 'fr'])}/{rng.randint(1, 30)}{rng.choice(['', '?q=1', '#t', '/'])}" for _ in range(n)]


def test_stated_rules_by_enumeration(spark):
    urls = [*random_urls(300, 1), None, "", "no url", "http://", "http://example.org", "://x.com/de/", "a://b://com/fr/", "HTTP://COM/de/" + "x" * 100_000]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], SCHEMA)
    verdicts = dict(RULES)
    got = {r["page_id"]: r for r in judged_urls(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        want = plain_rule(u, RULES)
        assert got[i]["rule"] == want, u
        assert want is None or got[i]["verdict"] == verdicts[want]
    assert judged_urls(df.where("false")).count() == 0
    assert {r["verdict"] for r in judged_urls(df, rules=()).collect()} == {"allow"}


@pytest.mark.parametrize("seed", [2, 3])
def test_mined_rules_by_enumeration(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        tokens = sorted({t for t in "abcdef" if rng.random() < 0.5} | ({"p", "q"} if rng.random() < 0.3 else set()))
        rows.append((tokens, ("a" in tokens and "b" in tokens and rng.random() < 0.95) or "p" in tokens or rng.random() < 0.05))
    rows += [(None, True), (["a"], None), ([], False)]
    got = {tuple(r["antecedent"]): (round(r["confidence"], 9), r["anchor"]) for r in mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    taught = [(frozenset(t), b) for t, b in rows if t is not None and b is not None]
    least = 0.1 * sum(b for _, b in taught)
    want = {}
    for size in range(1, 9):
        for c in itertools.combinations("abcdefpq", size):
            if ("p" in c) != ("q" in c):  # they always come together
                continue
            inside = [b for t, b in taught if t.issuperset(c)]
            if sum(inside) >= least and (sum(inside) + 1) / (len(inside) + 2) >= 0.8:
                want[c] = round((sum(inside) + 1) / (len(inside) + 2), 9)
    want = {c: v for c, v in want.items() if not any(set(d) < set(c) and want[d] >= v for d in want)}
    assert {c: v for c, (v, _) in got.items()} == want and want
    often = {t: sum(t in s for s, _ in taught) for t in "abcdefpq"}
    assert all(anchor == min(c, key=lambda t: (often[t], t)) for c, (_, anchor) in got.items())
    # the most confident rule whose tokens a URL has
    urls = spark.createDataFrame([(i, sorted(t)) for i, (t, _) in enumerate(taught)], "i int, tokens array<string>")
    for r in match_rules(urls, mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))).collect():
        fits = [v for c, v in want.items() if set(c) <= set(r["tokens"])]
        assert (r["confidence"] is None and not fits) or round(r["confidence"], 9) == max(fits)


def test_labels_from_elsewhere(spark):
    bad = [f"http://{h}.com/{i}" for i in range(30) for h in ("cheap-pills", "shop.cheap-pills")]
    good = [f"http://h{i % 7}.com/{i}" for i in range(200)]
    labelled = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in good] + [(None, True), ("http://x.com", None)], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "https://www.cheap-pills.com/new"), (2, "https://h3.com/new"), (2, "https://h3.com/new"), (3, None), (None, "http://a.org/es/")], "page_id long, url string")
    got = judged_urls(pages, labelled=labelled).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in got) == [(0, "allow"), (1, "block"), (2, "allow"), (2, "allow"), (3, "allow")]
    assert judged_urls(pages, labelled=labelled.where("not bad")).where(F.col("verdict") == "block").count() == 0


def test_mined_rules_decide_given_pages(spark):
    got = judged_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert got.where("rule is null and verdict = 'block'").count() > 0


def test_signs_far_down_the_url_are_found(spark):
    path = lambda i, x: f"http://h{i}.com/a{i % 7}/b{i % 5}/c{i % 3}/d{i % 2}/{x}/f{i}?" + "&".join(f"k{k}=1" for k in range(9)) + f"&{x}last=2"
    rows = [(path(i, "pills"), True) for i in range(100)] + [(path(i, "news"), False) for i in range(100)]
    hosts = [(f"http://sign.{'x.' * 8}h{i}.org/", True) for i in range(60)] + [(f"http://{'x.' * 8}h{i}.org/", False) for i in range(60)]
    for taught in (rows, hosts):
        labelled = spark.createDataFrame(taught, "url string, bad boolean")
        got = judged_urls(labelled.select(F.lit(1).alias("page_id"), "url"), rules=(), labelled=labelled).where("verdict = 'block'").count()
        assert got == sum(b for _, b in taught)


def test_what_reaches_the_driver_is_bounded_by_bad_rows(spark):
    rng = random.Random(4)
    url = lambda n: "http://h.com/" + "/".join(f"{'abcdefgh'[rng.randrange(8)]}{'xyz'[rng.randrange(3)]}" for _ in range(n))
    rows = [(url(30), False) for _ in range(3000)] + [(url(5), True) for _ in range(20)]
    tokens = spark.createDataFrame(rows, "url string, bad boolean").select(url_tokens(F.col("url")).alias("tokens"), "bad")
    bad = [r["tokens"] for r in tokens.where("bad").collect()]
    found = frequent_tokens(tokens, 0.1 * 20)
    assert 0 < len(found) <= sum(map(len, bad)) / 20 / 0.1
    want = {t for t in set().union(*bad) if sum(t in b for b in bad) >= 2}
    assert set(found) == want
    assert all(n == tokens.where(F.array_contains("tokens", t)).count() for t, (n, _) in list(found.items())[:3])
