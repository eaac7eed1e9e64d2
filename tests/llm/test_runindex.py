import hashlib
import random

import numpy as np
import pytest

from foldspan.llm import runindex as R

SCHEMA = "doc_id bigint, text string, extra int"


def plain(texts, length):
    """Per text the bytes that a string covers which starts twice, by counting all strings."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for x in data:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    out = []
    for x in data:
        covered = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                covered[i : i + length] = [True] * length
        kept = bytes(b for b, c in zip(x, covered, strict=True) if not c)
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(x), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def samples(rng, n, alphabet):
    src = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4)]
    return ["".join(rng.choice(src)[rng.randint(0, 5) : rng.randint(5, 60)] for _ in range(rng.randint(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_repeated_starts_agree_with_counting_for_all_block_sizes(seed):
    rng = random.Random(seed)
    for alphabet in ("a", "ab", "abcd", "aé漢\x00 "):
        regions = [t.encode() for t in samples(rng, rng.randint(1, 9), alphabet)]
        for length, block in ((3, 20), (8, 64), (16, 1000)):
            count = {}
            for r in regions:
                for i in range(len(r) - length + 1):
                    count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
            for r, got in zip(regions, R.repeated_starts(regions, length, block), strict=True):
                assert got.tolist() == [i + length <= len(r) and count[r[i : i + length]] > 1 for i in range(len(r))]


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_and_suffix_order_agree_with_plain_search(seed):
    rng = random.Random(seed)
    for alphabet in ("a", "ab", "abcdef"):
        text = b"\xff".join(t.encode() for t in samples(rng, 5, alphabet)) + b"\xff"
        index = R.RunIndex(np.frombuffer(text, np.uint8))
        assert R.suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        patterns = [t.encode() for t in samples(rng, 5, alphabet)] + [b"", b"zz"]
        found = index.matching_statistics([np.frombuffer(p, np.uint8) for p in patterns], 12)
        for p, ms in zip(patterns, found, strict=True):
            assert ms.tolist() == [max(n for n in range(min(12, len(p) - i) + 1) if p[i : i + n] in text) for i in range(len(p))]


def test_equal_strings_have_an_equal_anchor():
    rng, length = random.Random(1), 24
    data = [t.encode() for t in samples(rng, 40, "abc")]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    flat = np.frombuffer(b"".join(data), np.uint8)
    for k in R.grams(length):
        at, h = R.anchors(flat, bounds, k, length)
        known = {}
        for x, lo in zip(data, bounds.tolist(), strict=False):
            for i in range(len(x) - length + 1):
                inside = {int(v) for a, v in zip(at.tolist(), h.tolist(), strict=True) if lo + i <= a <= lo + i + length - k}
                assert known.setdefault(x[i : i + length], inside) & inside


def test_rows_agree_with_counting(spark):
    rng = random.Random(5)
    texts = [*samples(rng, 60, "abcdefgh"), None, "", "short", "é" * 70, "x" * 300, "y" * 39, "q" * 40]
    texts += [texts[3], texts[3], "漢字" * 30, texts[7] + "tail of its own"]
    rows = [(i if i % 9 else None, t, 1) for i, t in enumerate(texts)] + [(1, texts[1], 1)]
    texts = [r[1] for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.remove_repeats(df, length=40, block=200).collect())
    assert got == sorted(plain(texts, 40))
    kept = {r["kept_sha256"]: r["kept"] for r in R.remove_repeats(df, length=40).where("kept is not null").collect()}
    assert kept and all(hashlib.sha256(bytes(v)).hexdigest() == k for k, v in kept.items())


def test_whole_texts_at_the_length_of_the_query(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage, line = word(700), word(61)
    texts = [word(rng.randint(0, 3000)) for _ in range(12)]
    texts += [word(500) + passage + word(300), passage[:399], word(50) + passage[150:551] + word(900), line * 40, word(90) + passage, word(400), "z" * 5000]
    texts += [texts[0]] * 3 + [None, ""]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.remove_repeats(df).collect()}
    assert got == dict(enumerate(plain(texts, 400)))


def test_an_empty_table_has_no_rows(spark):
    assert R.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
