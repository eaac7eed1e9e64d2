import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspan.functions import vectors as V
from foldspan.functions.text import char_ngrams
from foldspan.operators import explore as X


def texts(spark, n=120, seed=0):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 14))), rng.randint(0, 1)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 1), (n + 1, "", 0)], "id bigint, text string, y int").repartition(3)


def collected(df):
    return {r["term"]: (r["df"], r["hits"], round(r["rate"], 12)) for r in df.collect()}


@pytest.mark.parametrize("bits", [64, X.MAP_BITS])
def test_grown_ngrams_are_those_of_a_plain_count(spark, bits):
    df = texts(spark)
    got = collected(X.grown_ngrams(df, F.col("text"), 2, 4, least=4, bits=bits))
    assert got == collected(X.terms_rates(df, "id", char_ngrams(F.col("text"), 2, 4), least=4)) and len({len(t) for t in got}) == 3
    a, b = (x.orderBy("term").collect() for x in (X.char_ngram_scan(df, F.col("text"), 3, 3, least=6), X.ngram_scan(df, "id", char_ngrams(F.col("text"), 3, 3), least=6)))
    assert [r["term"] for r in a] == [r["term"] for r in b] and [r["q"] for r in a] == pytest.approx([r["q"] for r in b])
    assert X.grown_ngrams(df.where("false"), F.col("text"), 1, 3).count() == 0


@pytest.mark.parametrize("block,buckets", [(2, 64), (256, 1 << 20)])
def test_pairs_are_those_of_enumeration(spark, block, buckets):
    rng = random.Random(1)
    outlines = {i: [f"n{min(rng.randrange(1, 30), rng.randrange(1, 30))}" for _ in range(rng.randint(0, 20))] for i in range(60)}
    y = {i: i % 3 % 2 for i in outlines}
    nodes = spark.createDataFrame([(i, x) for i, v in outlines.items() for x in v], "id bigint, node string").repartition(3)
    labels = spark.createDataFrame([(i, v, "x") for i, v in y.items()], "id bigint, y int, node string")
    want = {}
    for i, v in outlines.items():
        for p in combinations(sorted(set(v)), 2):
            want.setdefault(p, []).append(y[i])
    want = {p: (len(v), round(sum(v) / len(v), 12)) for p, v in want.items() if len(v) >= 4}
    got = {(r["a"], r["b"]): (r["n"], round(r["rate"], 12)) for r in X.pair_support(nodes, labels, 4, block, buckets).collect()}
    assert got == want and want
    assert X.pair_support(nodes.where("false"), labels, 1).count() == 0


def test_chunk_vectors_agree_with_numpy(spark):
    rng = random.Random(2)
    rows = [(i % 50, [f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 7, 30, 400]))]) for i in range(60)] + [(99, None), (98, ["x"] * 5000)]
    encode, width, stride = V.hash_encoder(8), 16, 12
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a row's chunks lie in many batches
    try:
        got = V.embed_chunked(spark.createDataFrame(rows, "id bigint, tokens array<string>").repartition(2), "id", F.col("tokens"), encode, width, stride).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for i, t in rows:
        if t is None:
            continue
        starts = [0]
        while starts[-1] + width < len(t):
            starts.append(starts[-1] + stride)
        parts = [t[s : s + width] for s in starts]
        v = sum(encode([" ".join(p)])[0] * len(p) for p in parts)
        want.append((i, np.round(v / max(np.linalg.norm(v), 1e-300), 9).tolist()))
    plain = lambda x: sorted((i, [round(a, 5) + 0.0 for a in v]) for i, v in x)
    assert plain((r["id"], r["vec"]) for r in got if any(r["vec"])) == plain(w for w in want if any(w[1]))


def test_embedded_rows_agree_with_numpy(spark):
    rows = [(i, None if i == 5 else f"text {i} é") for i in range(150)]
    encode = V.hash_encoder(12)
    got = {r["id"]: r["vec"] for r in V.embed(spark.createDataFrame(rows, "id bigint, t string"), "id", F.col("t"), encode, batch=16).collect()}
    assert all(np.allclose(got[i], encode([t or ""])[0], atol=1e-6) for i, t in rows) and len(got) == 150


def test_pairs_leave_a_task_block_by_block(spark, monkeypatch):
    made, kind = {}, type(spark.range(1))
    plain = kind.mapInArrow

    def caught(self, func, *a, **k):
        made[func.__name__] = (func, self)
        return plain(self, func, *a, **k)

    monkeypatch.setattr(kind, "mapInArrow", caught)
    nodes = spark.createDataFrame([(i, f"n{j}") for i in range(4) for j in range(6)], "id bigint, node string")
    X.pair_support(nodes, spark.createDataFrame([(i, i % 2) for i in range(4)], "id bigint, y int"), 2, 3, 64)
    func, df = made["rows"]
    sizes = [b.num_rows for b in func(iter(df.toArrow().combine_chunks().to_batches()))]
    assert max(sizes) <= 9 and sum(sizes) == 4 * 15
