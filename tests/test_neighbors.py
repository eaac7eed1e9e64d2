import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldspan.operators import neighbors as N

SCHEMA = "id bigint, vec array<double>, y double, extra string"


def table(spark, rows, parts=3):
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], float(y), "x") for i, v, y in rows], SCHEMA)
    return df.repartition(parts)


def plain(queries, candidates, k):
    """All pairs in lists, ordered by (distance, id)."""
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    out = {}
    for i, q, _ in queries:
        if i is None or q is None:
            continue
        near = sorted({(round(float(1 - unit(q) @ unit(v)), 12), j, y) for j, v, y in candidates if j is not None and v is not None and j != i})
        out[i] = [(j, y) for _, j, y in near[:k]]
    return {i: x for i, x in out.items() if x}


def found(df):
    out = {}
    for r in df.orderBy("query", F.round("distance", 12), "id").collect():
        out.setdefault(r["query"], []).append((r["id"], r["y"]))
    return out


@pytest.mark.parametrize("block_rows", [None, 7, 64])
def test_nearest_agrees_with_all_pairs(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(i, v, i % 3) for i, v in enumerate(rng.normal(size=(150, 5)).tolist())]
    df = table(spark, rows)
    assert found(N.nearest(df.where("id % 4 = 0"), df, 6, block_rows=block_rows)) == plain(rows[::4], rows, 6)


@pytest.mark.parametrize("block_rows", [None, 9])
def test_ties_go_by_id(spark, block_rows):
    same = [(i, [1.0, 2.0, 3.0], i % 2) for i in range(60)]
    df = table(spark, same)
    got = found(N.nearest(df, df, 5, block_rows=block_rows))
    assert got == {i: [(j, float(j % 2)) for j in range(7) if j != i][:5] for i in range(60)}
    mixed = same + [(100 + i, [1.0, 2.0, 3.0 + (i + 1) / 100], 0) for i in range(20)]
    df = table(spark, mixed)
    assert found(N.nearest(df, df, 4, block_rows=block_rows)) == plain(mixed, mixed, 4)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 0.0], 0), (3, None, 1), (None, [1.0, 1.0], 1), (4, [0.5, 0.5], 0), (4, [0.5, 0.5], 0)]
    df = table(spark, rows)
    assert found(N.nearest(df, df, 3)) == plain(rows, rows, 3)
    none = df.where("false")
    for q, c in ((none, df), (df, none), (none, none)):
        assert N.nearest(q, c, 3).count() == 0 and N.soft_vote(q, c).count() == 0 and N.nearest_by_codes(q, c, 3).count() == 0


def test_soft_vote_agrees_with_all_pairs_for_all_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v, i % 2) for i, v in enumerate(rng.normal(size=(80, 4)).tolist())]
    df = table(spark, rows)
    for block_rows in (None, 11):
        for r in N.soft_vote(df.where("id < 9"), df, 0.3, block_rows=block_rows).collect():
            w = [(np.exp(-np.linalg.norm(np.array(rows[r["query"]][1]) - v) / 0.3), y) for i, v, y in rows if i != r["query"]]
            assert r["log_p"] == pytest.approx(np.log(sum(a * y for a, y in w) / sum(a for a, _ in w)), rel=1e-9)


def test_codes_find_most_neighbours_and_only_true_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).tolist(), i % 2) for i in range(600)]
    df = table(spark, rows)
    exact = N.nearest(df, df, 10)
    for block_rows in (1 << 14, 40):
        near = N.nearest_by_codes(df, df, 10, tables=10, bits=4, probes=2, block_rows=block_rows)
        assert N.recall(near, exact).first()["recall"] >= 0.9
        wrong = near.join(N.nearest(df, df, 599).select("query", "id", F.col("distance").alias("real")), ["query", "id"], "left")
        assert wrong.where("real is null or abs(distance - real) > 1e-9").count() == 0


def test_the_plan_takes_no_vector_to_the_driver(spark):
    import inspect

    assert "toLocalIterator" not in inspect.getsource(N) and "broadcast" not in inspect.getsource(N)


def test_a_pair_of_blocks_has_few_distances_in_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    side = lambda n: pa.table({"id": np.arange(n), "vec": pa.array(list(rng.normal(size=(n, 8)))), "y": np.zeros(n), "cb": pa.array(np.zeros(n, np.int32))})
    q, c = side(2048), side(4096)
    tracemalloc.start()
    found = N._best_of(3, "cb")(q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 2048 and peak < 64 << 20


def test_every_row_of_the_table_is_a_query(spark, sf_dir):
    from foldspan import catalog

    catalog.register_all()
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = v.count()
    assert catalog.QUERIES["q_knn_smooth"](spark, sf_dir).select("query").distinct().count() == n
    assert catalog.QUERIES["q_top1_purity"](spark, sf_dir).first()["n"] == n
    assert not [q for q in ("q_knn_smooth", "q_top1_purity") if "% 20" in catalog.SQL[q]]


def test_floats_are_shuffled_as_floats_with_the_same_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v, i % 2) for i, v in enumerate(rng.normal(size=(60, 6)).astype(np.float32).tolist())]
    df = table(spark, rows).withColumn("vec", F.col("vec").cast("array<float>"))
    assert dict(N._sides(df, df, "id", "vec", "y")[0].dtypes)["vec"] == "array<float>"
    assert found(N.nearest(df, df, 4, block_rows=16)) == plain(rows, rows, 4)
    assert dict(N._sides(df, table(spark, rows), "id", "vec", "y")[0].dtypes)["vec"] == "array<double>"
