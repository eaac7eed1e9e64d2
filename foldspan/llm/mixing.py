"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by their membership pattern, the set of sources they belong to. Each pattern is a node
with the words of its documents, which it may give once for nothing, a second time at a cost and a third time at
a higher one; each source is a sink with its quota. The cheapest full flow says how often each pattern is used,
and documents are then chosen by a seeded hash: all of a pattern for each whole pass, and a prefix for the rest.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.llm.textops import WORD
from foldspan.plans.lineage import cut

#: Cost a word of the first, second and third pass.
REPEAT_COSTS = (0, 1, 3)
SEED = "mix-1"
#: The prefix is searched in the hash order, so many buckets at a time.
BUCKETS, ROUNDS = 256, 2


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text.cast("string"), F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[int], most: int) -> list[float]:
    """Shares of the total in proportion to the weights, none above ``most`` times its size."""
    out, left, weight = [0.0] * len(sizes), sum(sizes), sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for n, i in enumerate(order):
        if left / weight * weights[i] > most * sizes[i]:
            out[i] = float(most * sizes[i])
            left, weight = left - most * sizes[i], weight - weights[i]
            continue
        for j in order[n:]:
            out[j] = left / weight * weights[j]
        break
    return out


def min_cost_flow(supply: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[int]) -> list[dict[int, int]]:
    """Words that each pattern gives to each source: a cheapest flow among the largest ones.

    Augments along cheapest paths in the residual network, found by relaxing its edges until nothing changes.
    """
    n, sink = len(supply) + len(quotas) + 2, len(supply) + len(quotas) + 1
    edges: list[list[int]] = []  # from, to, left, cost; edge k ^ 1 is its reverse

    def edge(a: int, b: int, capacity: int, cost: int) -> int:
        edges.extend(([a, b, capacity, cost], [b, a, 0, -cost]))
        return len(edges) - 2

    for p, words in enumerate(supply):
        for c in costs:
            edge(0, 1 + p, words, c)
    routes = {(p, s): edge(1 + p, 1 + len(supply) + s, len(costs) * supply[p], 0) for p in range(len(supply)) for s in members[p]}
    for s, q in enumerate(quotas):
        edge(1 + len(supply) + s, sink, q, 0)
    while True:
        far, by = [float("inf")] * n, [-1] * n
        far[0], changed = 0, True
        while changed:
            changed = False
            for k, (a, b, left, cost) in enumerate(edges):
                if left > 0 and far[a] + cost < far[b]:
                    far[b], by[b], changed = far[a] + cost, k, True
        if by[sink] < 0:
            break
        path, at = [], sink
        while at:
            path.append(by[at])
            at = edges[by[at]][0]
        push = min(edges[k][2] for k in path)
        for k in path:
            edges[k][2] -= push
            edges[k ^ 1][2] += push
    out: list[dict[int, int]] = [{} for _ in supply]
    for (p, s), k in routes.items():
        if edges[k ^ 1][2]:
            out[p][s] = edges[k ^ 1][2]
    return out


def seeded_passes(rows: DataFrame, given: dict, size: str, order: str) -> DataFrame:
    """``rows`` with ``passes``: of each pattern the whole passes, and one more for a prefix in the order of the hash.

    ``rows`` has ``pattern`` and a hash ``order`` as hexadecimal text. The prefix ends in one bucket of the hash, and
    in one bucket of that bucket, found by partial sums; only the rows of the last bucket are ordered. One row that
    is left, with the size nearest to the words that are still missing, is added where it brings the sum nearer.
    """
    spark = rows.sparkSession
    digits = 2
    goal = {p: (words % total if total else 0, words // total if total else 0) for p, (words, total) in given.items()}
    state = {p: (0, "") for p, (rest, _) in goal.items() if rest}  # words before the bucket, bucket
    for r in range(1, ROUNDS + 1):
        if not state:
            break
        near = spark.createDataFrame([(p, b) for p, (_, b) in state.items()], "pattern string, bucket string")
        inside = rows.join(F.broadcast(near), "pattern").where(F.col(order).startswith(F.col("bucket")))
        sums = inside.groupBy("pattern", F.substring(order, 1, digits * r).alias("bucket")).agg(F.sum(size).alias("words")).collect()
        for p in list(state):
            before = state[p][0]
            for row in sorted((x for x in sums if x["pattern"] == p), key=lambda x: x["bucket"]):
                if before + row["words"] >= goal[p][0]:
                    state[p] = (before, row["bucket"])
                    break
                before += row["words"]
    plan = [(p, int(k), int(rest), *state.get(p, (0, None))) for p, (rest, k) in goal.items()]
    plan_df = spark.createDataFrame(plan, "plan_pattern string, whole long, rest long, before long, edge string")
    with_plan = rows.join(F.broadcast(plan_df), F.col("pattern").eqNullSafe(F.col("plan_pattern")), "left")
    bucket = F.substring(order, 1, digits * ROUNDS)
    w = Window.partitionBy("pattern", "at_edge").orderBy(order, size).rowsBetween(Window.unboundedPreceding, 0)
    flagged = with_plan.withColumn("at_edge", F.coalesce(bucket == F.col("edge"), F.lit(False)))
    edge = flagged.where("at_edge").withColumn("upto", F.col("before") + F.sum(size).over(w))
    edge = edge.withColumn("more", (F.col("upto") <= F.col("rest")).cast("long")).drop("upto")
    covered = edge.groupBy("pattern").agg((F.first("rest") - F.first("before") - F.coalesce(F.sum(F.col(size) * F.col("more")), F.lit(0))).alias("gap")).collect()
    other = flagged.where("not at_edge").withColumn("more", F.coalesce(bucket < F.col("edge"), F.lit(False)).cast("long"))
    picked = edge.unionByName(other)
    # of the rows that are left, the one that fills the gap best
    gaps = spark.createDataFrame([(r["pattern"], r["gap"]) for r in covered if r["gap"]], "gap_pattern string, gap long")
    picked = picked.join(F.broadcast(gaps), F.col("pattern") == F.col("gap_pattern"), "left")
    off = F.abs(F.col(size) - F.col("gap"))
    best = picked.where((F.col("more") == 0) & (off < F.col("gap"))).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), F.col(order).alias("o"), F.col(size).alias("s"))).alias("best")).collect()
    fill = spark.createDataFrame([(r["pattern"], r["best"]["o"], r["best"]["s"]) for r in best], "fill_pattern string, fill_order string, fill_size long")
    picked = picked.join(F.broadcast(fill), (F.col("pattern") == F.col("fill_pattern")) & (F.col(order) == F.col("fill_order")) & (F.col(size) == F.col("fill_size")), "left")
    passes = F.col("whole") + F.greatest(F.col("more"), F.col("fill_size").isNotNull().cast("long"))
    return picked.withColumn("passes", F.coalesce(passes, F.lit(0))).drop("plan_pattern", "whole", "rest", "before", "edge", "at_edge", "more", "gap_pattern", "gap", "fill_pattern", "fill_order", "fill_size")


def mixed_sizes(rows: DataFrame, weights=None, most: int = 3, seed: str = SEED) -> tuple[DataFrame, dict]:
    """Passes of each row of ``rows`` (id, size, sources: array of strings, maybe with a null) and the targets by source.

    Sources are ordered by code point, null last; ``weights(i)`` is the weight of the i-th, 1, 2, 3 repeating if not
    given. A document that is in several sources counts for each of them. A source without words has target 0.
    """
    key = F.to_json(F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.coalesce(F.concat(F.lit("0"), s), F.lit("1"))))))
    rows = rows.withColumns({"pattern": key, "order": F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))})
    patterns = sorted((r["pattern"], int(r["words"] or 0)) for r in rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect())
    members = [json.loads(p) for p, _ in patterns]
    sources = sorted({s for m in members for s in m})
    sizes = [sum(w for m, (_, w) in zip(members, patterns, strict=True) if s in m) for s in sources]
    weigh = [(weights(i) if weights else 1 + i % 3) for i in range(len(sources))]
    targets = capped_targets(sizes, weigh, most)
    flow = min_cost_flow([w for _, w in patterns], [[sources.index(s) for s in m] for m in members], [int(t + 0.5) for t in targets], REPEAT_COSTS[:most])
    given = {p: (sum(f.values()), w) for (p, w), f in zip(patterns, flow, strict=True)}
    picked = seeded_passes(rows, given, "size", "order")
    return picked, {s[1:] if s[0] == "0" else None: (sizes[i], targets[i]) for i, s in enumerate(sources)}


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=None, most: int = 3, seed: str = SEED) -> DataFrame:
    """``(id_col, size, source_size, target, taken)`` of every row of ``df``.

    ``source_col`` is a string or, for overlapping sources, an array of strings; source_size and target are then
    those of the row's first source by code point. ``taken`` is the row's size times its passes, at most ``most``
    times its size. A null text has size 0 and nothing is taken of it; a null source is a source of its own; the
    order depends on the seed and the id only, so that reruns agree; rows with equal ids go by their size.
    An empty table has no rows; a table without words has targets of 0 and takes nothing.
    Only sums by pattern and hash bucket reach the driver, never rows.
    """
    spark = df.sparkSession
    overlapping = df.schema[source_col].dataType.typeName() == "array"
    listed = F.col(source_col) if overlapping else F.array(F.col(source_col).cast("string"))
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(None).cast("string")))
    rows = cut(df.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), listed.alias("sources")))
    picked, targets = mixed_sizes(rows, weights, most, seed)
    names = spark.createDataFrame([(s, int(a), float(b)) for s, (a, b) in targets.items()], "name string, source_size long, target double")
    first = F.element_at(F.array_sort("sources"), 1)
    return picked.join(F.broadcast(names), first.eqNullSafe(F.col("name")), "left").select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))
