import random

from pyspark.sql import functions as F

from foldspan.llm.wrappers import extract_pages


def texts(spark, pages, host=lambda i: "h"):
    df = spark.createDataFrame([(i, host(i), p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"].split("\n\n") if r["text"] else [] for r in extract_pages(df, F.col("url")).collect()}


def test_repeated_pages_keep_what_only_they_have(spark):
    a = "<body><nav>menu here</nav><article><h1>Head A</h1><p>first of a</p><ul><li>one of a<li>two of a</ul><p>end of a</p></article></body>"
    b = "<body><nav>menu here</nav><article><p>first of b</p></article></body>"
    got = texts(spark, [a, a, b])
    assert got[0] == got[1] == ["Head A", "first of a", "one of a", "two of a", "end of a"] and got[2] == ["first of b"]


def test_headings_that_articles_share_stay(spark):
    page = "<body><div class=top><h2>Site news</h2></div><{1}><h1>Title {0}</h1><p>text of {0}</p><h2>Conclusion</h2><p>so much for {0}</p></{1}><footer><h2>Contact</h2></footer></body>"
    for tag in ("article", "div"):
        got = texts(spark, [page.format(i, tag) for i in range(4)])
        assert got[2] == ["Title 2", "text of 2", "Conclusion", "so much for 2"]


def test_a_paragraph_of_links_takes_no_other_with_it(spark):
    page = "<body><div class=post><h1>Title {0}</h1><p>short {0}</p><p><a href=x>a very long link text about page {0} that goes on and on, longer than all the rest of it</a></p><p>more {0}</p></div></body>"
    got = texts(spark, [page.format(i) for i in range(4)])
    assert got[1][:2] == ["Title 1", "short 1"] and got[1][-1] == "more 1" and len(got[1]) == 4
    linked = "".join(f"<p><a href=x>see page {i} of {{0}} too</a></p>" for i in range(6))
    page = "<body><div class=post><h1>Title {0}</h1><p>plain words of {0}</p><p>other words of {0}</p>" + linked + "</div></body>"
    assert texts(spark, [page.format(i) for i in range(4)])[3] == ["Title 3", "plain words of 3", "other words of 3"]


def test_names_that_only_begin_like_those_of_other_parts(spark):
    page = "<body><article><h1>T{0}</h1><p class='share-price'>price {0}</p><div class='search-results'>found {0}</div><p class='related-work'>work {0}</p><div class='share-buttons'>tell {0}</div><div class='related-posts'>also {0}</div></article></body>"
    assert texts(spark, [page.format(i) for i in range(4)])[0] == ["T0", "price 0", "found 0", "work 0"]


def test_long_streams_are_aligned_whole(spark):
    tags = ["<p>{}</p>", "<h3>{}</h3>", "<ul><li>{}</ul>", "<pre>{}</pre>", "<blockquote>{}</blockquote>"]
    rng, pages, want = random.Random(2), [], []
    for i in range(3):
        blocks = [f"words {k} of page {i}" for k in range(1500 + 40 * i)]
        body = "".join(rng.choice(tags).format(b) for b in blocks)
        pages.append(f"<body><div class=menu>menu</div><article>{body}</article><div>the same</div></body>")
        want.append(blocks)
    got = texts(spark, pages)
    assert [got[i] for i in range(3)] == want


def test_random_templates_agree_with_what_was_put_in(spark):
    """Hosts with templates of their own; each page's text is known before the page is made."""
    rng, pages, want, host = random.Random(7), [], [], []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    around = ["<nav><a href=a>{}</a></nav>", "<header><p>{}</p></header>", "<div class='sidebar-box'><p>{}</p></div>", "<aside>{}</aside>", "<div class=cookie-notice>{}</div>", "<form><p>{}</p></form>", "<script>{}</script>", "<div class='ad slot'>{}</div>"]
    after = ["<footer><p>{}</p></footer>", "<section id=comments><p>{}</p></section>", "<div class='related-posts'><ul><li><a href=b>{}</a></ul></div>", "<style>{}</style>"]
    for h in range(12):
        box = rng.choice(["article", "main", "div class=story", "section id=entry"])
        before, behind = (rng.sample(x, rng.randint(1, len(x))) for x in (around, after))
        fixed, heading = {t: phrase(4) for t in before}, phrase(2)
        for _ in range(rng.randint(3, 7)):
            blocks = [("h1", phrase(3))]
            for _ in range(rng.randint(1, 6)):
                blocks.append((rng.choice(["p", "p", "p", "blockquote", "li", "h2"]), phrase(rng.randint(9, 30))))
            blocks.insert(rng.randint(1, len(blocks)), ("h2", heading))
            inner = "".join(f"<ul><{t}>{b}</{t}></ul>" if t == "li" else f"<{t}>{b}</{t}>" for t, b in blocks)
            top = "".join(t.format(fixed[t]) for t in before)
            end = "".join(t.format(phrase(5)) for t in behind)
            pages.append(f"<html><body>{top}<{box}>{inner}</{box.split()[0]}>{end}</body></html>")
            want.append([b for _, b in blocks])
            host.append(str(h))
    pages, want, host = [*pages, pages[0]], [*want, want[0]], [*host, host[0]]
    got = texts(spark, pages, lambda i: host[i])
    wrong = [i for i in range(len(pages)) if got[i] != want[i]]
    assert not wrong, (pages[wrong[0]], got[wrong[0]], want[wrong[0]])
