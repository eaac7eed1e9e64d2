import math

import numpy as np
import pytest

from foldspan.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, x string"


def plain(rows, components=4):
    """The same from one numpy matrix: deviations as whole numbers, components from the covariance of the distinct rows."""
    ok = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in ok})
    n = len(distinct)
    sums = [sum(c) for c in zip(*distinct, strict=True)]
    a = np.array(distinct, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in ok:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for k in range(min(components, len(values))):
            if values[k] > 1e-12 * values.sum():
                out.setdefault((i, k + 1), []).append((n, deviation, float((np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k])), float(values[k] / values.sum())))
    return out


def compare(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in W.whitened(df, **more).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], r["whitened"], r["explained"]))
        assert r["identity_error"] < 1e-6
    want = plain(rows)
    assert got.keys() == want.keys()
    sign = {}
    for key, found in got.items():
        for (n, dev, w, e), (n2, dev2, w2, e2) in zip(sorted(found, key=str), sorted(want[key], key=str), strict=True):
            assert (n, dev) == (n2, dev2) and e == pytest.approx(e2, rel=1e-9)
            if abs(w2) > 1e-6:
                assert sign.setdefault(key[1], math.copysign(1, w * w2)) == math.copysign(1, w * w2)
            assert abs(w) == pytest.approx(abs(w2), rel=1e-7, abs=1e-8)
    return got


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.arange(1, d + 1)).astype(np.float32).tolist()


def test_whitened_rows_agree_with_numpy(spark):
    compare(spark, list(enumerate(vectors(300, 7))), block_rows=16)


def test_odd_rows(spark):
    v = vectors(40, 5)
    odd = [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0]]
    got = compare(spark, [*enumerate(v), (7, v[7]), (7, v[8]), (None, v[1]), (100, v[0]), *((200 + i, o) for i, o in enumerate(odd))])
    assert len(got[7, 1]) == 3 and not [k for k in got if k[0] is not None and k[0] >= 200]


def test_dependent_entries_and_narrow_vectors_have_fewer_components(spark):
    a = vectors(50, 2)
    assert {k[1] for k in compare(spark, [(i, [x, y, x, y]) for i, (x, y) in enumerate(a)])} == {1, 2}
    assert {k[1] for k in compare(spark, [(i, [x]) for i, (x, _) in enumerate(a)])} == {1}


def test_no_variance_and_no_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0, 0, "") for i in range(9)] + [(10, [], 0, 0, "")], SCHEMA)
    assert W.whitened(df).collect() == []
    assert W.whitened(df.where("false")).collect() == []
    assert W.whitened(df.where("vec_id = 10")).collect() == []


def test_a_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(i, [float(2**i), float(i)], 0, 0, "") for i in range(50)], SCHEMA)
    assert any(r["deviation"] is None for r in W.whitened(df).collect())
