"""Bootstrap draws, the metric callback, and how often a plan scans its input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.operators import harness, metrics
from sondera.plans import catalog

SF = "/root/testdata/sf0.001"


def frame(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")


def scans(df):
    """Scans of files in the plan that ran; branches that reuse an exchange have none."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan parquet")


@pytest.mark.parametrize("k", [1, 7, 16, 17, 400])
def test_cells_draw_poisson_numbers(k):
    n = 400
    w = metrics.draws(np.arange(n, dtype=np.int64) * 0x9E3779B97F4A7, np.full(n, k), np.arange(500), 3).ravel()
    assert abs(w.mean() - k) < 5 * (k / w.size) ** 0.5
    assert abs(w.var() / k - 1) < 0.03
    skew = ((w - w.mean()) ** 3).mean() / w.std() ** 3
    assert abs(skew - k**-0.5) < 0.06


def test_draws_of_a_cell_do_not_depend_on_its_neighbours():
    cell, count = np.array([5, 1 << 40, -3], np.int64), np.array([1, 30, 4])
    whole = metrics.draws(cell, count, np.arange(50), 1)
    assert all((metrics.draws(cell[i : i + 1], count[i : i + 1], np.arange(50), 1)[0] == whole[i]).all() for i in range(3))
    assert (metrics.draws(cell, count, np.arange(50), 2) != whole).any()


def test_callback_of_the_auc_equals_the_built_in_path(spark, monkeypatch):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 700)
    s = np.round(y + rng.normal(0, 1, 700), 1)
    df = frame(spark, y, s)
    want = metrics.bootstrap_ci(df, 40, fn=lambda h: metrics.from_histogram(h, ["rep"]).select("rep", F.col("auc").alias("value"))).first()
    monkeypatch.setattr(metrics, "CHUNK", 7)  # scores that go on from one chunk to the next
    got = metrics.bootstrap_ci(df, 40).first()
    assert tuple(got) == pytest.approx(tuple(want))


def test_callback_takes_any_metric(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    df = frame(spark, y, np.round(y + rng.normal(0, 1, 400), 1))
    tpr = lambda h: metrics.from_histogram(h, ["rep"], (0.1,)).select("rep", F.col("tpr_1").alias("value"))
    r = metrics.bootstrap_ci(df, 30, fn=tpr).first()
    assert r["kept"] == 30 and r["lo"] <= metrics.ranking(df, (), (0.1,)).first()["tpr_1"] <= r["hi"]


def test_paired_difference_of_a_score_and_itself_is_zero(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 200)
    df = frame(spark, y, y + rng.normal(0, 1, 200)).withColumn("same", F.col("score") * 2)
    r = metrics.bootstrap_ci(df, 25, scores=("score", "same")).first()
    assert (r["lo"], r["mid"], r["hi"]) == pytest.approx((0, 0, 0)) and r["kept"] == 25


def test_bootstrap_without_a_class_or_rows(spark):
    for rows in ([1, 1, 1], []):
        r = metrics.bootstrap_ci(frame(spark, rows, [0.1] * len(rows)), 10).first()
        assert r["lo"] is None and r["kept"] == 0


def test_strict_thresholds_keep_the_budget(spark):
    df = frame(spark, [0, 0, 0, 0, 1, 1], [0.1, 0.4, 0.4, 0.4, 0.4, 0.5])
    loose, strict = (metrics.ranking(df, (), (0.25,), strict=x).first() for x in (False, True))
    assert (loose["thr_25"], loose["strict_25"], loose["tpr_25"]) == (0.4, False, 1.0)
    assert (strict["thr_25"], strict["strict_25"], strict["tpr_25"]) == (0.4, True, 0.5)


def test_null_keys_and_scores(spark):
    rows = [(1, 0.9, None, "q"), (1, 0.2, "g", None), (0, 0.1, None, None), (0, 0.3, None, "q"), (1, None, "g", "q")]
    df = spark.createDataFrame(rows, "label int, score double, generator string, quality string")
    out = {(r["level"], r["key"]): r for r in harness.measure(harness.complete(df)).collect()}
    assert out["generator", "nan"]["auc"] == 1.0 and out["generator", "g"]["auc"] == 0.5
    assert out["quality", "nan"]["auc"] == 1.0 and out["quality", "q"]["n"] == 2
    assert out["overall", "all"]["n_pos"] == 2


def test_input_contract_counts(spark):
    df = spark.createDataFrame([(1, float("nan")), (0, None), (2, 0.5), (None, 0.5), (0, 0.1)], "label int, score double")
    assert tuple(metrics.input_contract(df).first()) == (5, 1, 1, 2)


@pytest.mark.parametrize("name, most", [("met1_roc_auc", 1), ("met11_summary", 2), ("har1_group_metrics", 1), ("har2_robustness", 1), ("har5_release_gate", 2), ("agg5_model_by_degradation", 1)])
def test_scans(spark, name, most):
    assert scans(catalog.QUERIES[name](spark, SF)) <= most


def test_rows_are_counted_before_they_are_grouped_by_levels(spark):
    rows = [(i % 2, float(i * 7 % 5), f"g{i % 3}", f"q{i % 4}") for i in range(60)]
    df = harness.complete(spark.createDataFrame(rows, "label int, score double, generator string, quality string"))
    plan = harness.measure(df)._jdf.queryExecution().optimizedPlan().toString()
    last = [line for line in plan.splitlines() if "Aggregate" in line or "Generate" in line][-2:]
    assert "Aggregate" in last[0] and "Generate" in last[1]  # below the counts only models are told apart
    assert "degradation" not in last[1] and "overall" not in last[1]
    out = harness.measure(df).where("level = 'overall'").first()
    whole = metrics.ranking(df).first()
    assert (out["auc"], out["eer"], out["eer_thr"], out["tpr_05"]) == (whole["auc"], whole["eer"], whole["eer_thr"], whole["tpr_05"])


@pytest.mark.parametrize("k", [1, 5, 16])
def test_draws_reach_the_cuts_that_they_are_above(k):
    import numpy as np

    cuts = metrics.poisson_cuts(k)
    u = np.r_[np.random.default_rng(k).integers(0, 2**32, 20_000, dtype=np.uint64).astype(np.uint32), np.array([c for c in cuts], np.uint32), np.uint32(0), np.uint32(2**32 - 1)]
    assert (metrics._passed(u, cuts) == sum((u >= np.uint32(c)).astype(np.int64) for c in cuts)).all()
