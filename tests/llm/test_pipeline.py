"""Each stage of the pipeline, and all of them, on small tables with every odd row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from foldspan.llm.langid import held_out
from foldspan.llm.mixing import mix_sources
from foldspan.llm.quality import fit_quality, scored
from foldspan.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"item{k}" for k in range(20))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "sta") for b in ("ben", "dor", "fil", "gan", "hem", "jun", "kos")]
    rows, labels = [], []

    def add(text, source="a", quality=None):
        rows.append((len(rows), text, "en", source, len(text or "")))
        if quality is not None:
            labels.append((rows[-1][0], quality, 0))

    for k in range(120):
        add(" ".join(rng.choices(words, k=80)), "abc"[k % 3], 1)
        add(" ".join(w + "###" for w in rng.choices(words, k=60)), "abc"[k % 3], 0)
    for k in range(12):  # near copies: a changed word of eighty
        w = rows[2 * k][1].split()
        w[k + 20] = "other"
        add(" ".join(w), "b")
    for k in range(4):
        add(rows[100 + 2 * k][1] + " " + ITEM.upper() + " " + rows[60][1], "c")
    for k in range(5):
        add(rows[80][1], None)  # exact copies
    rows += [(None, rows[4][1], "en", "a", 1), (None, " ".join(rng.choices(words, k=70)), "en", "b", 1), (6, rows[6][1], "en", "a", 1), (900, None, "en", "a", 0), (901, "", None, None, 0), (902, " ".join(rng.choices(words, k=30_000)), "en", "c", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def counted(df):
    return Counter(map(tuple, df.select("doc_id", "text").collect()))


def test_quality(spark, folder):
    docs = table(spark, folder, "documents")
    kept = P.keep_quality(spark, docs, folder)
    assert kept.columns == docs.columns
    model = fit_quality(docs, labels=table(spark, folder, "labels").where(~held_out(F.col("doc_id"))))
    assert counted(kept) == counted(scored(docs, model).where("predicted = 1"))
    judged = kept.join(table(spark, folder, "labels"), "doc_id").groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in judged}.get(0, 0) == 0 and {r["quality"]: r["count"] for r in judged}[1] >= 119


def test_near_copies(spark, folder):
    docs = table(spark, folder, "documents")
    rows = sorted(counted(docs), key=lambda r: (r[0] is None, r[0] or 0))
    root = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    left = P.drop_copies(spark, docs, folder)
    assert left.columns == docs.columns and counted(left) == Counter(rows[k] for k in set(root))


def test_benchmark(spark, folder):
    docs = table(spark, folder, "documents")
    want = Counter({r: n for r, n in counted(docs).items() if len(shingles(r[1]) & shingles(ITEM)) < 0.8 * len(shingles(ITEM))})
    left = P.drop_benchmark(spark, docs, folder)
    assert left.columns == docs.columns and counted(left) == want and want.total() == docs.count() - 4


def test_mixing(spark, folder):
    docs = table(spark, folder, "documents").where("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = P.mix(spark, docs, folder)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources(docs).collect() if r["taken"]}
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter(taken)


def test_sharding(spark, folder):
    docs = table(spark, folder, "documents")
    placed = P.shard(spark, docs, folder)
    assert counted(placed) == counted(docs)
    slots = {}
    for r in placed.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(s) for s in slots.values()]
    assert set(slots) == set(range(P.SHARDS)) and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_all_stages(spark, folder, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality", "near_copies", "benchmark", "mixing", "sharding"]
    got = P.run(spark, folder)
    docs = table(spark, folder, "documents")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert counted(got) == counted(docs) and {"shard", "slot"} <= set(got.columns) and got.count() > 100
    ids = {r["doc_id"] for r in got.collect()}
    assert not ids & {*range(1, 240, 2)} and not ids & {*range(240, 256)}  # bad ones, near copies and those with the item
    table(spark, folder, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, folder, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
