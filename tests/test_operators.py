"""Behaviour that SQL does not cover: known answers, bounds, errors, determinism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.functions import scalars as S
from sondera.operators import calibrate, fusion, harness, images, lsh, metrics, replay, signals, split
from sondera.sources import io
from sondera.streaming import monitors


def frame(spark, y, s):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, label int, score double")


def brute_auc(y, s):
    p, n = [b for a, b in zip(y, s) if a == 1], [b for a, b in zip(y, s) if a == 0]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))


def test_auc_with_ties(spark):
    y, s = [0, 0, 1, 1, 0, 1], [0.1, 0.4, 0.4, 0.8, 0.4, 0.9]
    assert metrics.ranking(frame(spark, y, s), (), ()).first()["auc"] == pytest.approx(brute_auc(y, s))


def test_auc_random(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    s = np.round(np.clip(0.5 + 0.25 * y + rng.normal(0, 0.2, 500), 0, 1), 2)
    r = metrics.ranking(frame(spark, y, s), (), (0.01, 0.05, 0.2)).first()
    assert r["auc"] == pytest.approx(brute_auc(y, s))
    assert r["tpr_01"] <= r["tpr_05"] <= r["tpr_2"]


def test_perfect_separation_and_empty_class(spark):
    r = metrics.ranking(frame(spark, [0] * 50 + [1] * 50, [0.1] * 50 + [0.9] * 50), (), (0.01,)).first()
    assert (r["auc"], r["eer"], r["tpr_01"]) == (1.0, 0.0, 1.0)
    one = metrics.ranking(frame(spark, [1, 1], [0.2, 0.3]), (), (0.01,)).first()
    assert one["auc"] is None and one["eer"] is None


def test_nan_score_raises(spark):
    with pytest.raises(Exception, match="NaN"):
        metrics.checked(frame(spark, [0, 1], [0.1, float("nan")])).collect()


def test_ece_of_one_value_and_range(spark):
    df = spark.createDataFrame([(1, 0.75), (0, 0.75), (1, 0.75), (1, 0.75)], "label int, prob double")
    assert metrics.ece(df).first()["ece"] == pytest.approx(0.0)
    with pytest.raises(Exception, match="outside"):
        metrics.ece(spark.createDataFrame([(1, 1.5)], "label int, prob double")).collect()


def test_bootstrap_interval_holds_the_estimate(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    df = frame(spark, y, y + rng.normal(0, 1, 300))
    r, auc = metrics.bootstrap_ci(df, 20).first(), metrics.ranking(df, (), ()).first()["auc"]
    assert r["lo"] < auc < r["hi"] and r["kept"] == 20


def manifest(spark):
    gens = ["authentic", "gan-a", "gan-b", "piper", "kokoro"]
    rows = [(f"f/{i}.wav", int(i % 5 > 0), gens[i % 5], "x", f"s{i % 40}", "audio", "native") for i in range(400)]
    return spark.createDataFrame(rows, "path string, label int, generator string, family string, source_id string, media_type string, quality string")


def test_split_is_clean_and_repeatable(spark):
    spec = split.SplitSpec(("piper",), 0.2, 0.2, 3)
    d = split.group_split(manifest(spark), spec)
    assert [r["problem"] for r in split.check_leakage(d).collect()] == [False] * 3
    assert {r["split"] for r in d.where("generator = 'piper'").collect()} == {"test"}
    assert sorted(map(tuple, d.select("path", "split").collect())) == sorted(map(tuple, split.group_split(manifest(spark), spec).select("path", "split").collect()))


def test_manifest_with_authentic_positive_raises(spark):
    bad = manifest(spark).withColumn("label", F.when(F.col("path") == "f/0.wav", 1).otherwise(F.col("label")))
    with pytest.raises(ValueError, match="authentic_positives"):
        split.validate_manifest(bad)
    with pytest.raises(ValueError, match="lacks"):
        split.validate_manifest(bad.drop("label"))


def test_blake_fractions_of_known_speakers(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([("1988",), ("2277",), ("1673",)], "s string").select("s", split.blake_fraction(F.col("s"))).collect()}
    assert got["1988"] == pytest.approx(0.0617, abs=1e-4) and got["2277"] == pytest.approx(0.1705, abs=1e-4) and got["1673"] == pytest.approx(0.441, abs=1e-3)


def test_banded_pairs(spark):
    h = 0x0F0F_1234_ABCD_7777
    rows = [("a", h), ("b", h ^ 1), ("c", ~h)]
    assert [tuple(r) for r in lsh.near_pairs(spark.createDataFrame(rows, "id string, hash long")).collect()] == [("a", "b", 1)]


def test_phash_is_stable_under_brightness():
    x = np.random.default_rng(0).normal(size=(2, 32, 32))
    a, b = lsh.phash64(x), lsh.phash64(x + 5)
    assert all(int(p ^ q).bit_count() <= 2 for p, q in zip(a, b)) and a[0] != a[1]


def test_gaussian_fit_recovers_parameters(spark):
    rng = np.random.default_rng(5)
    z = np.r_[rng.normal(-2, 0.7, 4000), rng.normal(3, 1.2, 4000)]
    r = calibrate.gaussian_fit(frame(spark, [0] * 4000 + [1] * 4000, 1 / (1 + np.exp(-z)))).first()
    assert (r["m0"], r["s0"], r["m1"], r["s1"]) == pytest.approx((-2, 0.7, 3, 1.2), abs=0.06)


def test_calibrators_keep_order_and_unknown_raises(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    df = frame(spark, y, np.clip(0.3 + 0.3 * y + rng.normal(0, 0.15, 300), 0.01, 0.99))
    for kind in ("temperature", "platt", "isotonic"):
        out = calibrate.fit_calibrator(df, kind)(df).orderBy("score").select("prob").toPandas()["prob"].to_numpy()
        assert (np.diff(out) >= -1e-9).all() and out.min() >= 0 and out.max() <= 1
    with pytest.raises(ValueError):
        calibrate.fit_calibrator(df, "magic")


def evidence_rows(spark, n=200):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        y = i % 2
        s = np.clip(0.5 + (0.25 if y else -0.25) + rng.normal(0, 0.1, 6), 0.01, 0.99)
        rows.append((i, y, *map(float, s), *(bool(b) for b in rng.random(6) > 0.2)))
    cols = ["id long", "label int"] + [f"s_{d} double" for d in S.DIMENSIONS] + [f"a_{d} boolean" for d in S.DIMENSIONS]
    return spark.createDataFrame(rows, ", ".join(cols))


def test_fusion_learns_and_explains(spark):
    df = evidence_rows(spark)
    head = fusion.fit(df, "id", epochs=15, rate=0.5)
    assert all(w > 0 for w in head.weights.values())
    r = fusion.score_scans(df, head).first()
    c = [abs(x["contribution"]) for x in r["evidence"]]
    assert c == sorted(c, reverse=True) and r["driver"] == r["evidence"][0]["dimension"]
    scored = df.withColumn("score", fusion.probability(head))
    assert metrics.ranking(scored, (), ()).first()["auc"] > 0.95


def test_gate_blocks_a_fall(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 4 > 0), ["authentic", "g1", "g2", "g3"][i % 4], float(np.clip((0.7 if i % 4 else 0.3) + rng.normal(0, 0.1), 0, 1))) for i in range(800)]
    old = spark.createDataFrame(rows, "id int, label int, generator string, score double")
    new = old.withColumn("score", F.when(F.col("generator") == "g2", F.col("score") - 0.35).otherwise(F.col("score")))
    t = lambda x: metrics.ranking(x, (), (0.01,)).select("tpr_01")
    g = lambda x: harness.group_metrics(x, "generator")
    r = harness.release_gate(g(new), g(old), t(new), t(old)).first()
    assert r["blocked"] and "g2" in r["reasons"]
    assert not harness.release_gate(g(old), g(old), t(old), t(old)).first()["blocked"]
    text = harness.report(harness.evaluate(old), title="T")
    assert text.startswith("# T") and "per_generator" in text


def test_reservoir_is_capped_and_mergeable(spark):
    df = spark.range(1500).select(F.concat(F.lit("g"), F.col("id") % 3).alias("generator"), F.col("id").alias("item"))
    whole = replay.reservoir(df, "generator", "item", 50)
    halves = replay.reservoir(df.where("item < 700"), "generator", "item", 50).unionByName(replay.reservoir(df.where("item >= 700"), "generator", "item", 50))
    merged = replay.reservoir(halves.select("generator", "item"), "generator", "item", 50)
    assert whole.count() == 150 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_wav_round_trip_and_csv(spark, tmp_path):
    x = np.sin(np.arange(1600) / 10) * 0.5
    sr, y = io.decode_wav(io.encode_wav(x, 16000))
    assert sr == 16000 and np.abs(x - y).max() < 1e-4
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips/a.wav").write_bytes(io.encode_wav(x, 8000))
    assert io.read_wav(spark, f"file://{tmp_path}/clips").select("sr").first()["sr"] == 8000
    m = manifest(spark).withColumn("split", F.lit("train")).withColumn("path", F.translate("path", "/", "\\"))
    io.write_csv(m.select(*split.MANIFEST), f"file://{tmp_path}/m")
    back = io.read_manifest(spark, f"file://{tmp_path}/m")
    assert back.count() == 400 and back.where("path like 'f/%'").count() == 400 and dict(back.dtypes)["source_id"] == "string"


def test_json_map_and_upsert(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a\\\\b.wav": {"gain": 1.5}, "c.wav": {"gain": 2.0}}')
    got = {r["key"]: r["gain"] for r in io.read_json_map(spark, f"file://{tmp_path}/log.json", "struct<gain:double>").collect()}
    assert got == {"a/b.wav": 1.5, "c.wav": 2.0}
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "name string, v int")
    assert io.upsert(spark, f"file://{tmp_path}/none", rows, "name").count() == 2
    io.upsert(spark, f"file://{tmp_path}/t", rows, "name")
    again = io.upsert(spark, f"file://{tmp_path}/t", spark.createDataFrame([("y", 5)], "name string, v int"), "name")
    assert {r["name"]: r["v"] for r in again.collect()} == {"x": 1, "y": 5}
    rows.write.parquet(f"file://{tmp_path}/plain")
    with pytest.raises(ValueError, match="not written by upsert"):
        io.upsert(spark, f"file://{tmp_path}/plain", rows, "name")


def test_stream_agrees_with_batch(spark, tmp_path):
    df = evidence_rows(spark, 120).withColumn("ts", F.timestamp_seconds(F.col("id") * 600))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = monitors.abstention(stream, fusion.Head()).writeStream.format("memory").queryName("abst").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    got = sorted(map(tuple, spark.table("abst").collect()))
    q.stop()
    assert got == sorted(map(tuple, monitors.abstention(df, fusion.Head()).collect()))


def test_streaming_reservoir_agrees_with_batch(spark, tmp_path):
    df = spark.range(300).select(F.concat(F.lit("g"), F.col("id") % 3).alias("generator"), F.col("id").alias("item"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = monitors.streaming_reservoir(stream, "generator", "item", 20).writeStream.format("memory").queryName("buf").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    last = {}
    for r in spark.table("buf").collect():
        last[r["key"]] = sorted(r["items"])
    q.stop()
    want = {}
    for r in replay.reservoir(df, "generator", "item", 20).collect():
        want.setdefault(r["generator"], []).append(str(r["item"]))
    assert last == {k: sorted(v) for k, v in want.items()}


def test_cli_writes_a_report_and_gates(spark, tmp_path):
    from sondera import cli

    rows = [(int(i % 2), float(i % 7 + 3 * (i % 2)), ["authentic", "g1"][i % 2]) for i in range(300)]
    spark.createDataFrame(rows, "label int, score double, generator string").write.parquet(f"file://{tmp_path}/old")
    worse = [(y, s - 4 * y, g) for y, s, g in rows]
    spark.createDataFrame(worse, "label int, score double, generator string").write.parquet(f"file://{tmp_path}/new")
    assert cli.main(["--scores", f"file://{tmp_path}/new", "--baseline", f"file://{tmp_path}/old", "--out", f"file://{tmp_path}/out", "--primary-fpr", "0.1"], spark) == 1
    assert "BLOCKED" in (tmp_path / "out/eval.md").read_text() and "overall" in (tmp_path / "out/eval.json").read_text()


def test_head_fit_equals_numpy(spark):
    """Without dropout the fit is plain batch descent: mean gradient, penalty a share of the rows."""
    import numpy as np

    from sondera.operators import fusion

    rng = np.random.default_rng(2)
    n, dims = 40, fusion.DIMENSIONS
    s, a, y = rng.uniform(0.05, 0.95, (n, len(dims))), rng.random((n, len(dims))) < 0.7, rng.integers(0, 2, n)
    s[0], a[0] = 0.5, True
    rows = [(i, int(y[i]), *map(float, s[i]), *map(bool, a[i])) for i in range(n)]
    schema = "id long, label int, " + ", ".join(f"s_{d} double" for d in dims) + ", " + ", ".join(f"a_{d} boolean" for d in dims)
    head = fusion.fit(spark.createDataFrame(rows, schema), "id", epochs=5, l2=0.5, dropout=0.0)
    x = np.where(a, np.log(s / (1 - s)), 0.0)
    w, b = np.full(len(dims), 1.0 / len(dims)), 0.0
    for _ in range(5):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.1 * (x.T @ err / n + 0.5 * w / n), b - 0.1 * err.mean()
    assert np.allclose([head.weights[d] for d in dims], w, atol=1e-9) and abs(head.bias - b) < 1e-9


def test_near_pairs_are_exact_and_blocks_do_not_matter(spark):
    import random

    from sondera.operators import lsh

    rng = random.Random(3)
    base = rng.getrandbits(64)
    vals = [base ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 8))) for _ in range(60)]
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    want = sorted((a, b) for a in range(60) for b in range(a + 1, 60) if (vals[a] ^ vals[b]).bit_count() <= 6)
    for block in (7, 500):
        assert sorted((r["a"], r["b"]) for r in lsh.near_pairs(df, block=block).collect()) == want


def test_lookup_fails_on_missing_keys(spark):
    import pytest

    from sondera.operators import split

    store = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sorted(r["v"] for r in split.lookup(spark.createDataFrame([(1,), (2,), (2,)], "id long"), store, {"id": "k"}).collect()) == ["a", "b", "b"]
    with pytest.raises(Exception, match="missing from the store"):
        split.lookup(spark.createDataFrame([(1,), (3,)], "id long"), store, {"id": "k"}).collect()


def test_near_pairs_in_wide_bands_meet_no_row_twice(spark):
    rng = np.random.default_rng(7)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)] + [(5, int(h[5])), (None, 1)], "id long, hash long")
    d = np.bitwise_count((h[:, None] ^ h[None, :]).view(np.uint64))
    want = sorted((j, i, int(d[i, j])) for i in range(300) for j in range(i) if d[i, j] <= 24)
    got = lsh.near_pairs(df, max_dist=24, bands=25, block=20)
    assert want and sorted(map(tuple, got.collect())) == want
    # rows meet in packed cells: joined for the buckets' sizes alone, not row by row
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_head_fit_keeps_a_row_once_and_its_weights_out_of_the_plan(spark, monkeypatch):
    kept, plans = [], []
    real_persist, real_cross = type(spark.range(1)).persist, type(spark.range(1)).crossJoin
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: kept.append(self.count()) or real_persist(self, *a))
    monkeypatch.setattr(type(spark.range(1)), "crossJoin", lambda self, other: plans.append(self) or real_cross(self, other))
    rows = [(i, i % 2, *(0.1 + 0.8 * (i * k % 11) / 11 for k in range(1, 7)), *([True] * 6)) for i in range(40)]
    schema = "id int, label int, " + ", ".join(f"s_{d} double" for d in fusion.DIMENSIONS) + ", " + ", ".join(f"a_{d} boolean" for d in fusion.DIMENSIONS)
    fusion.fit(spark.createDataFrame(rows, schema), "id", epochs=3)
    assert kept == [40]
    assert len(plans) == 3 and all(p.sameSemantics(plans[0]) for p in plans)
