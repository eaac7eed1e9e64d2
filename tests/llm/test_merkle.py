import hashlib
import zlib

from foldspan.llm import merkle as M

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, digest string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """Every tree built level by level in lists, every proof read off it."""

    def leaf(r):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))

    def climb(nodes):
        """Levels of a tree, the last one of one node."""
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def way(levels, i):
        for level in levels[:-1]:
            a = i // 16 * 16
            yield "".join(level[a:i]), "".join(level[i + 1 : a + 16])
            i //= 16

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    root, out = (top[-1] or [None])[0], []
    for g, s in enumerate(names):
        for i, (_, digest, r) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            steps = [*way(trees[s], i), *way(top, g)]
            lower = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            x = leaf((r[0], lower, *r[2:])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else digest
            for a, b in steps:
                x = h(a + x + b)
            out.append((r[0], digest, trees[s][-1][0], root, h("".join(a + b for a, b in steps)), x, x == root))
    return out


def compare(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    got = [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in M.verified_rows(df, FIELDS, "source", "doc_id").collect()]
    key = lambda t: tuple(map(str, t))
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


def row(i, text="Text A", source="s"):
    return (i, text, "en", source, None if i is None or i % 3 else 7, 1, "x")


def test_trees_of_all_shapes_agree_with_lists(spark):
    rows = []
    for source, n in (("a", 1), ("b", 16), ("c", 17), ("d", 257), (None, 33), ("", 2), ("é", 31)):
        rows += [row(1000 * len(rows) + i, f"Word {i} É" * (i % 4), source) for i in range(n)]
    got = compare(spark, rows)
    assert {r[-1] for r in got} == {True, False}


def test_many_sources_make_a_tree_of_levels(spark):
    compare(spark, [row(i, "T", f"s{i:03d}") for i in range(300)])


def test_nulls_repeats_long_texts_and_equal_rows(spark):
    rows = [row(5, None), row(5, None), row(5, "Other"), row(None, "A"), row(None, "A"), row(None, None, None), row(8, ""), row(-3, "Z" * 300_000), row(2**60, "\x00")]
    compare(spark, rows)
    compare(spark, [row(7, "Same")] * 40)


def test_one_row_and_an_empty_table(spark):
    assert compare(spark, [row(4)])[0][-1] is (zlib.crc32(b"4") % 5 != 0)
    compare(spark, [])
