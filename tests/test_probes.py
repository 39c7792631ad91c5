"""Layer probes against NumPy, the feature store, report and gate."""

import numpy as np
import pytest

from sondera.operators import probes
from sondera.sources import io

DIM = 5


def store(spark, n=120, layers=(0, 3, 7)):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    x = {v: rng.normal(size=(n, DIM)) * (1 + np.arange(DIM)) + 100 + np.outer(y, np.full(DIM, 0.3 * v)) for v in layers}
    split = ["train" if i % 2 else ("val" if i % 4 else "test") for i in range(n)]
    rows = [(i, v, int(y[i]), split[i], x[v][i].tolist()) for v in layers for i in range(n)]
    return spark.createDataFrame(rows, "path long, layer int, y int, split string, vec array<double>").repartition(5), x, y, np.array(split)


def numpy_fit(x, y, c):
    m, s = x.mean(0), x.std(0)
    z, w = np.c_[(x - m) / s, np.ones(len(x))], np.zeros(DIM + 1)
    ridge = np.diag(np.r_[np.ones(DIM), 0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + ridge, c * z.T @ (p - y) + ridge @ w)
    return w[:-1] / s, w[-1] - (w[:-1] / s) @ m


@pytest.mark.parametrize("c", [1.0, 0.01])
def test_all_layers_equal_their_own_fit(spark, c):
    df, x, y, split = store(spark)
    got = probes.fit(df.where("split = 'train'"), DIM, c)
    assert sorted(k[0] for k in got) == [0, 3, 7]
    for (layer,), (w, b) in got.items():
        train = split == "train"
        want = numpy_fit(x[layer][train], y[train], c)
        assert np.allclose(w, want[0], atol=1e-6) and abs(b - want[1]) < 1e-5
        scores = {r["path"]: r["score"] for r in probes.scored(df.where(f"layer = {layer}"), got).collect()}
        assert all(abs(scores[i] - (x[layer][i] @ want[0] + want[1])) < 1e-5 for i in scores)


def test_separable_constant_and_single_class_layers(spark):
    rows = [(i, 0, i % 2, [float(i % 2), 1.0]) for i in range(20)] + [(i, 1, 1, [float(i), 2.0]) for i in range(20)]
    got = probes.fit(spark.createDataFrame(rows, "path int, layer int, y int, vec array<double>"), 2, 1e4)
    assert list(got) == [(0,)]
    w, b = got[(0,)]
    assert w[0] + b > 3 and b < -3 and w[1] == 0


def test_report_gate_and_choice(spark):
    rows = [(layer, s, i % 2, float(i % 2 if layer else i // 10)) for layer in (0, 1) for s in ("val", "test") for i in range(20)]
    table = probes.report(spark.createDataFrame(rows, "layer int, split string, y int, score double"))
    got = {r["layer"]: r for r in probes.gated(table).collect()}
    assert got[1]["passed"] and got[1]["val_auc"] == 1 and not got[0]["passed"] and got[0]["test_auc"] == 0.5
    assert tuple(probes.choice(table).first()) == (1, 0)


def test_feature_store_reads_and_replaces_single_layers(spark, tmp_path):
    df, *_ = store(spark)
    path = f"file://{tmp_path}/store"
    io.write_vectors(df.select("path", "layer", "vec"), path)
    got = io.read_vectors(spark, path, [3])
    assert got.count() == 120 and got.select("layer").distinct().first()["layer"] == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan or "layer#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    io.write_vectors(df.where("layer = 3 and path < 5").select("path", "layer", "vec"), path)
    assert sorted((r["layer"], r["count"]) for r in io.read_vectors(spark, path).groupBy("layer").count().collect()) == [(0, 120), (3, 5), (7, 120)]
    assert io.missing_vectors(df.select("path", "layer"), spark, path).count() == 115
