"""op11: treaps, the traversal and the whole ranking against plain scoring and SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.llm import queries
from sondera.llm import ranked_search as R

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall(text.translate(FOLD)) if text else []


def plain(docs, items, k):
    """(item, rank, doc, score) by scoring every document for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            s = sum(R.weight(n_docs, df[t]) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if s:
                scored.append((-s, i is None, i, s))
        for rank, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1):
            out.append((item, rank, i, s))
    return out


def ranked(spark, tmp_path, docs, items, k=20, **options):
    index = R.TreapIndex.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), f"file://{tmp_path}/index", **options)
    got = index.search(spark.createDataFrame(items, "item_id long, text string"), k)
    return index, sorted(map(tuple, got.collect()), key=str)


def corpus(rng, n=120):
    words = [f"w{i}" for i in range(40)] + ["Ünï", "Zoë", "A1b", "中文"]
    weights = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30), p=weights / weights.sum()))) for i in range(n)]
    items = [(i, ", ".join(rng.choice(words, rng.integers(0, 8)))) for i in range(12)]
    return docs, items


def test_treaps_are_heaps_in_search_order():
    rng = np.random.default_rng(0)
    for _ in range(100):
        sizes = rng.integers(1, 12, rng.integers(1, 6))
        starts = np.cumsum(sizes) - sizes
        impacts = rng.integers(1, 5, sizes.sum())
        roots, left, right = R.treaps(starts, impacts)

        def holds(node, a, b):
            if a == b:
                return node == -1
            return node == a + np.argmax(impacts[a:b]) and holds(left[node], a, node) and holds(right[node], node + 1, b)

        assert all(holds(r, s, s + z) for r, s, z in zip(roots, starts, sizes))
    assert [len(x) for x in R.treaps(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0, 0]


def test_terms_are_those_of_the_pattern():
    for text in ("Ab-c_d 12x", "É ÀB c", "a\x7fb\x80c", "", None, "日本 x", "´`^{|}~"):
        assert [t.decode() for t in R.terms_of(text)] == terms(text)


@pytest.mark.parametrize("shard_terms", [40, 10**6])
def test_ranking_equals_plain_scoring(spark, tmp_path, shard_terms):
    docs, items = corpus(np.random.default_rng(1))
    _, got = ranked(spark, tmp_path, docs, items, 5, shard_terms=shard_terms)
    assert got == sorted(plain(docs, items, 5), key=str)


def test_waves_blocks_and_seeds_change_nothing(spark, tmp_path, monkeypatch):
    docs, items = corpus(np.random.default_rng(2), 200)
    monkeypatch.setattr(R, "SEED_SHARE", 2)
    index, got = ranked(spark, tmp_path, docs, items, 7, shard_terms=60)
    want = sorted(plain(docs, items, 7), key=str)
    assert got == want and index.shards().count() > 20
    rows = R.TreapIndex.open(spark, index.path).search(spark.createDataFrame(items, "item_id long, text string"), 7, block_terms=6)
    assert sorted(map(tuple, rows.collect()), key=str) == want
    shard = R.Shard(index.shards().first().asDict())
    names = sorted({t for i in items for t in R.terms_of(i[1])})
    at = shard.find(names, np.array([R._hash(t) for t in names], np.uint64))
    there = at >= 0
    found = []
    for wave in (1, 1 << 19):
        monkeypatch.setattr(R, "WAVE", wave)
        best = R.Best(1, 5)
        shard.search(np.zeros(there.sum(), np.int64), shard.roots[at[there]], np.ones(there.sum(), np.int64), best)
        found.append([x.tolist() for x in best.found[0]])
    assert found[0] == found[1]


def test_subtrees_are_pruned():
    rng = np.random.default_rng(3)
    build = R._Build(4000, 40000)
    for i in range(4000):
        build.add(i, " ".join(f"t{x}" for x in rng.integers(0, 50, 10)) + (" rare" * 3 if i % 400 == 7 else ""))
    shard = R.Shard(build.row())
    names = [b"rare", b"t1", b"t2"]
    at = shard.find(names, np.array([R._hash(t) for t in names], np.uint64))
    best = R.Best(1, 5)
    met = shard.search(np.zeros(3, np.int64), shard.roots[at], np.array([9000, 100, 100]), best)
    assert met < 0.2 * shard.sizes[at].sum() and set(best.found[0][1] % 400) == {7}


def test_ties_nulls_repeats_and_long_texts(spark, tmp_path):
    docs = [(i, "same words here") for i in range(30)] + [(5, "same words here"), (None, "same words here"), (40, None), (41, ""), (42, "--- !"), (43, "long " * 50_000 + "same")]
    items = [(1, "same"), (1, "same"), (2, None), (3, ""), (4, "absent"), (5, "long same same"), (None, "here")]
    _, got = ranked(spark, tmp_path, docs, items, 33)
    assert got == sorted(plain(docs, items, 33), key=str)
    assert [r[2] for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[1])][:8] == [0, 1, 2, 3, 4, 5, 5, 6]


def test_an_item_id_with_two_texts_has_two_rankings(spark, tmp_path):
    docs = [(0, "a b"), (1, "a"), (2, "b")]
    _, got = ranked(spark, tmp_path, docs, [(1, "a"), (1, "b")], 2)
    assert got == sorted(plain(docs, [(1, "a")], 2) + plain(docs, [(1, "b")], 2), key=str)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    _, got = ranked(spark, tmp_path / "a", [], [(1, "x")])
    assert got == []
    _, got = ranked(spark, tmp_path / "b", [(1, "x")], [])
    assert got == []
    docs = spark.createDataFrame([(1, "x y"), (2, "x")], "doc_id long, text string")
    extra = docs.select(F.lit(7).alias("score"), F.lit(8).alias("rank"), F.lit(9).alias("item_id"), F.col("doc_id").alias("a.b"), F.col("text").alias("body t"), F.lit(1).alias("i"))
    items = spark.createDataFrame([("k", "x")], "id string, text string").select(F.col("id").alias("q.q"), "text", F.lit(3).alias("doc_id"), F.lit(0).alias("terms"))
    index = R.TreapIndex.build(extra, f"file://{tmp_path}/c", id_col="a.b", text_col="body t")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in index.search(items, item_id="q.q").orderBy("rank").collect()] == [("k", 1, 2), ("k", 2, 1)]


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()["op11_ranked_search"](spark, SF)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == sorted(duck.sql(R.ORACLE_SQL).fetchall())
