"""Containment of items against plain set counts."""

import random

import numpy as np
from pyspark.sql import functions as F

from foldspan.llm.containment import ItemIndex, contained_items, decontaminate, shingle_hashes

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def runs(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs, items):
    return sorted(
        (d, i, len(b), len(a & b)) for d, t, *_ in docs for i, u, *_ in items if d is not None and i is not None for a, b in [(runs(t), runs(u))] if b and a and len(a & b) >= 0.8 * len(b)
    )


def cases(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 9, 17, 40, 130]))), None) for i in range(60)]
    items += [(60, items[5][1], None), (61, None, None), (62, "", None), (None, items[6][1], None)]
    docs = []
    for d in range(80):
        text = rng.choices(words, k=rng.choice([0, 3, 50, 400]))
        for i in rng.sample(range(60), 3):
            part = items[i][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):  # changed words
                part[rng.randrange(len(part))] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((d, " ".join(text).upper() if d % 3 else "\n".join(text), "clash"))
    docs += [(3, items[0][1], None), (3, items[0][1], None), (None, items[9][1], None), (200, None, None), (201, " ", None), (202, " ".join(rng.choices(words, k=60_000)) + " " + items[7][1], None)]
    return docs, items


def test_items_by_plain_sets(spark):
    docs, items = cases(1)
    got = contained_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert sorted((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got.collect()) == plain(docs, items)


def test_rows_that_hold_an_item_go(spark):
    docs, items = cases(2)
    left = decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    want = [(d, t) for d, t, _ in docs if not any(runs(u) and runs(t) and len(runs(t) & runs(u)) >= 0.8 * len(runs(u)) for _, u, _ in items)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=key) == sorted(want, key=key)
    assert not any(r["doc_id"] is None for r in left)


def test_one_index_for_each_size_class():
    rng = random.Random(3)
    items = [(n, " ".join(f"{n}.{k}" for k in range(n + 4))) for n in (1, 2, 3, 4, 7, 8, 9, 100)]
    index = ItemIndex(items, 5, 0.8)
    assert [p.length for p in index.partitions] == [1, 1, 1, 2, 4, 26]
    for n, text in items:
        w = np.array([hash(x) & 0xFFFF for x in text.split()], np.uint64)
        assert len(shingle_hashes(w, 5)) == n
    # whatever share of an item is left, a document that has enough of it is a candidate
    for at, (n, text) in enumerate(items):
        import xxhash

        hashes = shingle_hashes(np.array([xxhash.xxh64_intdigest(x.encode()) for x in text.split()], np.uint64), 5)
        for _ in range(30):
            keep = rng.sample(range(n), -(-4 * n // 5))
            assert at in index.candidates(hashes[keep])


def test_empty_tables_and_one_name(spark):
    docs, items = spark.createDataFrame(cases(4)[0], DOC), spark.createDataFrame(cases(4)[1], ITEM)
    none = F.lit(False)
    assert contained_items(docs.where(none), items).count() == contained_items(docs, items.where(none)).count() == 0
    assert decontaminate(docs.where(none), items).count() == 0 and decontaminate(docs, items.where(none)).count() == docs.count()
    same = contained_items(docs.drop("item_id"), items.drop("doc_id").withColumnRenamed("item_id", "doc_id"), item_id="doc_id")
    assert same.columns[:2] == ["doc_id", "item_doc_id"] and same.count() == len(plain(*cases(4)))
