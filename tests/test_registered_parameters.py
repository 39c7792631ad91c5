"""Registered queries run with the parameters of the operators that they stand for, over whole tables."""

import datetime

import pytest

from sondera.plans import catalog


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('small')}"
    day = datetime.date(2020, 1, 1)
    rows = [(i // 4, i % 4 + 1, "R" if i % 3 == 0 else "N", float(i * 37 % 50 + 1), float(i * 53 % 97), "O", day) for i in range(48)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate date").coalesce(1).write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame([(i, "F" if i % 2 else "O", day) for i in range(20)], "o_orderkey long, o_orderstatus string, o_orderdate date").coalesce(1).write.parquet(f"{out}/orders.parquet")
    return out


@pytest.mark.parametrize("name", ["met9_bootstrap_ci", "met10_paired_bootstrap"])
def test_bootstrap_has_1000_replicates(spark, small, name):
    row = catalog.QUERIES[name](spark, small).first()
    assert row["kept"] == 1000 and row["lo"] < row["mid"] < row["hi"]


def test_head_is_fitted_for_300_epochs(spark, small, monkeypatch):
    from sondera.operators import fusion

    steps, real = [], fusion.sigmoid
    monkeypatch.setattr(fusion, "sigmoid", lambda x: steps.append(1) or real(x))
    assert catalog.QUERIES["fus4_fit_head"](spark, small).count() == 7
    assert len(steps) == 300


def test_mixed_batch_has_all_new_rows(spark, small):
    rows = catalog.QUERIES["ft5_mixed_batch"](spark, small).collect()
    assert sum(not r["replayed"] for r in rows) == 32
    assert sum(r["replayed"] for r in rows) == 16
