"""Compression bands against plain counts, and verdicts that single limits decide."""

import math
import random
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from foldspan.llm.compression import BANDS, CHUNK_BYTES, compression_bands, fit_bands, labelled_good


def ratio(raw):
    return len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))


def words_of(rng, n, length=7):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, length))) for _ in range(n))


def plain(text, bands):
    text = text or ""
    raw = text.encode()
    words = raw.split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    repeats = len({i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    cuts = [0]
    while len(raw) - cuts[-1] > CHUNK_BYTES + CHUNK_BYTES // 2:
        cuts.append(cuts[-1] + CHUNK_BYTES)
    parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]

    def fits(p):
        lo, hi = [b[1:] for b in bands if b[0] <= len(p)][-1]
        return lo <= ratio(p) <= hi

    base = len(words) < 10 or 100 * repeats > 20 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(s) for s in "#*$%&|<>"), dup, repeats, base, not base and fits(raw) and all(map(fits, parts))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_all_given_texts_by_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = compression_bands(docs).collect()
    assert len(got) == 200
    for r in got:
        assert tuple(r[n] for n in NAMES) == plain(r["text"], BANDS), r["doc_id"]
        assert math.isclose(r["ratio"], ratio(r["text"].encode()))


def test_limits_one_by_one(spark):
    rng = random.Random(4)
    nine, ten = words_of(rng, 9), words_of(rng, 10)
    clean = words_of(rng, 4000)
    twice = " ".join([*(w := words_of(rng, 95).split()), *w[:5]])  # 10 of 100 words
    thrice = " ".join([*(w := words_of(rng, 40).split()), *w[:5]])  # 10 of 45 words
    digits = "".join(rng.choices("0123456789", k=30)) + " "
    # one part of many that is all one character: only its chunk is outside
    patched = clean[: 2 * CHUNK_BYTES] + " ".join("z" * rng.randint(1, 40) for _ in range(400))[:CHUNK_BYTES] + clean[2 * CHUNK_BYTES :]
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(12)) for _ in range(400))
    texts = [nine, ten, clean, twice, thrice, patched, noise, None, "", " \n ", digits * 12, "w\nw\n\nw # $\n" * 3, clean * 20]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, ten), (1, ten)], "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("ratio", F.lit("clash"))
    bands = ((0, 0.0, 9.0), (2048, 1.3, 2.0))
    got = compression_bands(df, bands=bands).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert tuple(r[n] for n in NAMES) == plain(r["text"], bands)
    by = {r["doc_id"]: r for r in got}
    assert (by[0]["base_failed"], by[1]["base_failed"], by[3]["base_failed"], by[4]["base_failed"]) == (True, False, False, True)
    assert by[2]["kept"] and not by[5]["kept"] and 1.3 <= by[5]["ratio"] <= 2.0 and by[5]["chunk_ratio_max"] > 2.0
    assert not by[6]["kept"] and by[6]["ratio"] < 1.3 and not by[6]["base_failed"]
    assert compression_bands(df.where("false")).count() == 0


def test_learned_limits(spark):
    rng = random.Random(5)
    good = [words_of(rng, rng.randint(60, 120)) for _ in range(300)]
    bad = [" ".join("".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(90)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(good + bad)) + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(300 + i, 0) for i in range(20)] + [(None, 1), (0, 1)], "doc_id long, quality int")
    texts = labelled_good(docs, labels)
    assert texts.count() == 300
    assert 60 < labelled_good(docs, labels, sample=100).count() < 140
    bands = fit_bands(texts)
    floors = [b[0] for b in bands]
    assert floors == sorted(floors) and floors[0] == 0
    assert fit_bands(texts.where("false")) == [tuple(b) for b in BANDS]
    for t in good:
        lo, hi = [b[1:] for b in bands if b[0] <= len(t.encode())][-1]
        assert 0.9 * lo < ratio(t.encode()) < 1.1 * hi
    got = compression_bands(docs, bands=bands).where("doc_id is not null").collect()
    assert sum(r["kept"] for r in got if r["doc_id"] < 300) >= 297
    assert sum(r["kept"] for r in got if r["doc_id"] >= 300) < sum(r["kept"] for r in compression_bands(docs).where("doc_id >= 300").collect())


def test_limits_come_from_all_good_texts(spark):
    rng = random.Random(6)
    texts = [words_of(rng, 400) for _ in range(120)]
    docs = spark.createDataFrame([(i % 100, t) for i, t in enumerate(texts)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 70)) for i in range(100)] + [(5, 1), (None, 1)], "doc_id long, quality int")
    good = labelled_good(docs, labels)
    assert good.count() == 90  # ids 0 to 69, of which 0 to 19 twice
    assert fit_bands(docs, labels=labels) == fit_bands(good) != [tuple(b) for b in BANDS]
    bands = [x[1:] for x in fit_bands(docs, labels=labels)]
    for raw in (t.encode() for i, t in enumerate(texts) if i % 100 < 70):
        assert any(lo <= ratio(raw) <= hi for lo, hi in bands)


def test_the_query_samples_no_labels(spark, sf_dir, monkeypatch):
    from foldspan.llm import queries as q

    seen = []
    fit = q.fit_bands
    monkeypatch.setattr(q, "fit_bands", lambda *a, **k: (seen.append((a[0].count(), k["labels"].count())), fit(*a, **k))[1])
    n = q.op1_compression_bands(spark, sf_dir).count()
    assert seen == [(n, spark.read.parquet(f"{sf_dir}/labels.parquet").count())]
