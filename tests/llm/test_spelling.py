"""op13: words, near words, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sondera.llm import queries, spelling

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=6, min_count=5, ratio=5, typo=199):
    """(word, form, root, n, n_near, form_n) by deleting and replacing every code point of every word."""
    n = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % typo == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}
    near, wild = defaultdict(set), defaultdict(set)
    for w in words:
        for p in range(len(w)):
            if (d := w[:p] + w[p + 1 :]) in words:
                near[w].add(d)
                near[d].add(w)
            wild[w[:p], w[p + 1 :]].add(w)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), k, len(near[w]), words.get(form.get(w))) for w, k in words.items())


def order(rows):
    return sorted(tuple(r) for r in rows)


def crowd(seed=0, n=400):
    """Texts of words that share stems, with variants of many counts."""
    rng = random.Random(seed)
    stems = ["internat", "abcdef", "résumé", "Straßen", "aaaaaa", "ÀÉÎõüñ"]
    words = []
    for _ in range(n):
        w = rng.choice(stems) + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 4)))
        words += [w] * rng.choice([1, 2, 5, 12, 60, 300])
    rng.shuffle(words)
    return [(i, " ".join(words[i::50]) + ("; " if i % 2 else "\n0")) for i in range(50)]


@pytest.mark.parametrize("few, halves", [(0, 100_000), (24, 100_000), (10**9, 7), (3, 40)])
def test_variants_equal_brute_force(spark, monkeypatch, few, halves):
    rows = crowd()
    monkeypatch.setattr(spelling, "FEW", few)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_halves=halves)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert order(got.collect()) == brute(rows)


def test_crowded_halves_give_what_one_by_one_gives():
    rng = random.Random(1)
    words = sorted({"stem" + "".join(rng.choice("ab") for _ in range(4)) for _ in range(16)})
    for half in (0, 1):
        named = [w if half == 0 else w[::-1] for w in words]
        owners = spelling.Owners(half, 4)
        owners.words, owners.counts = named, [1] * len(named)
        for w in named:
            for probe in {w, w[:-1], w[1:], w + "a", "a" + w, w[:5] + "b" + w[5:], w[:2] + w[3:]}:
                if not (probe.startswith("stem") if half == 0 else probe.endswith("mets")):
                    continue
                want = [i for i, x in enumerate(named) if spelling.near(x, probe)]
                owners._index()
                few, spelling.FEW = spelling.FEW, 0
                try:
                    assert sorted(owners.near(probe)) == want, (half, probe)
                finally:
                    spelling.FEW = few


def test_near_is_one_edit():
    assert spelling.near("abc", "abd") and spelling.near("abc", "ab") and spelling.near("abc", "xabc") and spelling.near("aab", "ab")
    assert not any((spelling.near("abc", "abc"), spelling.near("abc", "a"), spelling.near("abcd", "abdc"), spelling.near("abc", "xbd"), spelling.near("", "")))


def test_chains_ties_and_roots(spark):
    counts = {"walking": 5, "walkings": 25, "walkingss": 125, "tieword": 5, "tiewordb": 30, "tieworda": 30, "loneword": 9}
    rows = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), typo=10**9).collect()}
    assert (got["walking"]["form"], got["walking"]["root"], got["walkingss"]["form"]) == ("walkings", "walkingss", None)
    assert got["tieword"]["form"] == "tieworda" and got["tieword"]["form_n"] == 30 and got["tieword"]["n_near"] == 2
    assert (got["loneword"]["n_near"], got["loneword"]["root"], got["loneword"]["form_n"]) == (0, "loneword", None)
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), ratio=1)


def test_nulls_empties_repeats_and_long_texts(spark):
    long = "longword" * 20_000
    rows = [(1, None), (2, ""), (None, "nullable nullable nullabel"), (3, "Repeated repeated×repeated")] + [(4, "repeated wordless")] * 6 + [(5, f"{long} ") for _ in range(5)] + [(6, "éclair÷éclair Éclair 東京 éclairs " * 40)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert order(got.collect()) == brute(rows)


def test_empty_tables_and_clashing_columns(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few words")], "doc_id long, text string")).count() == 0
    rows = [(1, "clashing " * 30 + "clashin " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("a.b"), F.col("text").alias("c d"), *(F.lit(1).alias(c) for c in ("word", "n", "i", "t", "form", "root")))
    assert order(spelling.variants(df, "a.b", "c d").collect()) == brute(rows)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert order(queries.queries()["op13_spelling"](spark, SF).collect()) == brute(docs)
