"""Registered queries on the smallest tables, whole, against brute force."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from sondera.llm import decontaminate, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def result(spark, name, *columns):
    return sorted(tuple(r) for r in queries.queries()[name](spark, SF).select(*columns).collect())


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op1_recall_and_scores(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()}
    got = result(spark, "op1_multiprobe_ann", "query_id", "rank", "vec_id", "score")
    found = {q: [(r, v, s) for q2, r, v, s in got if q2 == q] for q in {g[0] for g in got}}
    assert set(found) == {i for i in rows if i % 20 == 0}
    met = 0
    for q, hits in found.items():
        scores = {i: float(rows[q] @ v) for i, v in rows.items() if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        met += len(set(best) & {v for _, v, _ in hits})
        assert [r for r, *_ in hits] == list(range(1, 21)) and all(abs(s - scores[v]) < 1e-14 for _, v, s in hits)
        assert [v for _, v, _ in hits] == sorted((v for _, v, _ in hits), key=lambda i: (-scores[i], i))
    assert met >= 0.9 * 20 * len(found)


def test_op5_equals_brute_force(spark, texts):
    assert result(spark, "op5_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.removed_bytes(texts, 200))


def test_op7_equals_brute_force(spark, texts):
    assert result(spark, "op7_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.removed_words(texts, 35))


def test_op9_equals_brute_force(spark, texts):
    assert result(spark, "op9_simhash", "doc_id", "fingerprint", "component_id") == sorted(brute.near_groups(texts, 4))


def test_op10_equals_brute_force(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.leaks(texts, items, decontaminate)
    got = {(d, i): s for d, i, s in result(spark, "op10_decontamination", "doc_id", "item_id", "score")}
    assert set(got) == set(want) and want and all(abs(got[k] - want[k]) < 1e-5 for k in want)
