"""Percentiles and prefix sums against numpy, with the values in one range and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspan.operators import ranks

VALUES = [(i % 3, None if i % 17 == 0 else float((i * 7919) % 613) / (1 if i % 2 else 7)) for i in range(3000)]


@pytest.fixture(params=[1 << 16, 20, 1])
def ranges(request, monkeypatch):
    """Rows of a range: all values in one range, in some dozens, in all that a sketch gives."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", request.param)


def test_percentiles_of_the_other_folds_are_those_of_numpy(spark, ranges):
    rows = [(i % 4 if i % 29 else None, v, float(i % 5) if g else -4.0, None) for i, (g, v) in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "fold int, v double, few double, none double").repartition(3)
    wanted = [*[(c, s) for c in ("v", "few") for s in (0.0, 0.25, 0.5, 0.9, 1.0)], ("none", 0.5)]
    got = ranks.fold_percentiles(df, wanted, 5)
    for f in range(5):  # no row is in the last fold
        for i, c in ((1, "v"), (2, "few")):
            values = [r[i] for r in rows if r[0] is not None and r[0] != f and r[i] is not None]
            for s in (0.0, 0.25, 0.5, 0.9, 1.0):
                assert got[f][c, s] == pytest.approx(np.percentile(values, 100 * s))
        assert got[f]["none", 0.5] is None
    assert ranks.fold_percentiles(df.where("false"), wanted, 1) == [dict.fromkeys(wanted)] and ranks.fold_percentiles(df, [], 2) == [{}, {}]


def test_percentiles_are_those_of_numpy(spark, ranges):
    df = spark.createDataFrame([*VALUES, (7, None), (None, 2.5)], "g int, v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["edges"] for r in ranks.exact_percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {0, 1, 2, None}
    assert got[None] == [2.5] * 6
    for g in (0, 1, 2):
        assert got[g] == pytest.approx(np.quantile([v for k, v in VALUES if k == g and v is not None], shares).tolist(), rel=1e-12)


def test_percentiles_of_columns_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    row = ranks.column_percentiles(df, ["a", "b"], [0.5, 0.75]).first()
    assert row["q0"] == [2.0, 3.0] and row["q1"] is None
    empty = ranks.column_percentiles(df.where("a > 9"), ["a", "b"], [0.5]).collect()
    assert len(empty) == 1 and empty[0]["q0"] is None and empty[0]["q1"] is None
    assert ranks.exact_percentiles(df.where("a > 9"), [], "a", [0.5]).first()["edges"] == [None]


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_are_those_of_one_pass(spark, ranges, descending):
    groups = {}
    for g, v in VALUES:
        if v is not None:
            groups[g, v] = groups.get((g, v), 0) + 1
    df = spark.createDataFrame([(g, v, n) for (g, v), n in groups.items()], "g int, v double, n bigint")
    want = {}
    for g in (0, 1, 2):
        total = 0
        for v in sorted((v for k, v in groups if k == g), reverse=descending):
            total += groups[g, v]
            want[g, v] = total
    assert {(r["g"], r["v"]): r["cum_n"] for r in ranks.prefix_sums(df, ["g"], "v", ["n"], descending).collect()} == want


def test_groups_are_made_once_for_ranges_and_sums(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    groups = spark.range(200).repartition(2).select((F.col("id") * 1.0).alias("p"), F.udf(told, "bigint")("id").alias("n"))
    assert ranks.prefix_sums(groups, [], "p", ["n"]).agg(F.max("cum_n")).first()[0] == 199 * 100
    assert seen.value == 200
