"""Exact quantiles, row numbers, covering keys, keyed tables, isotonic blocks, clips of several shapes, stateful streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.operators import calibrate, lsh, order, replay
from sondera.sources import io
from sondera.streaming import stateful


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=200), 1), "c": np.array([3.5]), None: np.full(40, 2.0)}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("a", None), ("only null", None)]
    out = order.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", {"q0": 0.0, "q1": 0.13, "med": 0.5, "q9": 1.0})
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        assert [got[k][c] for c in ("q0", "q1", "med", "q9", "lo", "hi", "n")] == pytest.approx([*np.quantile(x, [0, 0.13, 0.5, 1]), x.min(), x.max(), len(x)])


def test_quantiles_without_groups_or_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert order.quantiles(df, [], "x", {"med": 0.5}).first()["med"] == 49.5
    assert order.quantiles(df.where("x < 0"), [], "x", {"med": 0.5}).count() == 0


def test_only_ranges_with_a_rank_are_put_in_order(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    out = order.quantiles(df, [], "x", {"med": 0.5})
    assert out.first()["med"] == pytest.approx(np.median(np.arange(20_000) * 7919 % 20_011))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate(keys=[s" not in plan and "percentile(" not in plan


def test_numbers_are_those_of_a_sort(spark):
    values = random.Random(0).sample(range(10**6), 500)
    rows = order.numbered(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), "v").collect()
    assert sorted((r["n"], r["v"]) for r in rows) == list(enumerate(sorted(values)))
    plan = replay.round_robin(spark.createDataFrame([(v,) for v in values], "v long"), "v", ["x", "y", "z"], ["e"])
    assert [r["voice"] for r in plan.orderBy("v").collect()] == [["x", "y", "z"][i % 3] for i in range(500)]


@pytest.mark.parametrize("taken", [1, 2, 3])
def test_covered_pairs_are_all_near_pairs_once(spark, monkeypatch, taken):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(3)]
    vals = [rng.choice(base) ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 8))) for _ in range(90)]
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(vals)], "id long, hash long")
    want = sorted((a, b, (vals[a] ^ vals[b]).bit_count()) for a in range(90) for b in range(a + 1, 90) if (vals[a] ^ vals[b]).bit_count() <= 6)
    monkeypatch.setattr(lsh, "covering_width", lambda *_: (6 + taken, taken))
    for block in (7, 500):
        assert sorted(map(tuple, lsh.covered_pairs(df, block=block).collect())) == want and any(w[2] == 6 for w in want)


def test_chance_meetings_stay_few(spark):
    n = 30_000
    df = spark.range(n).select("id", F.xxhash64("id").alias("hash"))
    groups, taken = order.covering_width(n, 6)
    assert taken >= 2
    keys = np.array([r["hash"] for r in df.collect()], np.int64).view(np.uint64)
    edges = [64 * g // groups for g in range(groups + 1)]
    from itertools import combinations
    from math import comb

    met = 0
    for s in combinations(range(groups), taken):
        mask = sum((1 << edges[g + 1]) - (1 << edges[g]) for g in s)
        _, k = np.unique(keys & np.uint64(mask), return_counts=True)
        met += int((k * (k - 1) // 2).sum())
    assert met < n**1.5 and comb(groups, taken) < 100
    assert lsh.covered_pairs(df, n=n).count() == 0


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = spark.range(200).select(F.col("id").cast("string").alias("name"), F.col("id").alias("v"))
    assert io.upsert(spark, path, first, "name", parts=8).count() == 200
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("part=*/*.parquet")}
    new = spark.createDataFrame([("5", -5, "x"), ("5", -9, "y"), ("new", 1, None)], "name string, v long, note string")
    for _ in range(2):
        got = {r["name"]: (r["v"], r["note"]) for r in io.upsert(spark, path, new, "name", parts=8).collect()}
        assert len(got) == 201 and got["5"] == (-5, "x") and got["new"] == (1, None) and got["6"] == (6, None)
    same = [p for p in stamp if p.exists() and p.stat().st_mtime_ns == stamp[p]]
    assert len({p.parent for p in same}) >= 6


def test_isotonic_blocks_equal_pooling_of_all_rows(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(600), 2)
    y = (rng.random(600) < s**2).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double").repartition(6)
    x = np.unique(s)
    cells = [(v, v, float(y[s == v].sum()), float((s == v).sum())) for v in x]
    want = [(lo, hi, a / w) for lo, hi, a, w in calibrate.pooled(cells)]
    got = sorted(map(tuple, calibrate.isotonic(df).collect()))
    assert np.allclose(got, want) and (np.diff([g[2] for g in got]) > 0).all()
    fitted = [g[2] for v in x for g in got if g[0] <= v <= g[1]]
    assert np.allclose(fitted, [max(min(y[(s >= a) & (s <= b)].mean() for b in x[x >= v]) for a in x[x <= v]) for v in x])
    probe = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "score double")
    out = [r["prob"] for r in calibrate.apply_isotonic(probe, calibrate.isotonic(df)).collect()]
    assert out[0] == pytest.approx(max(1e-6, got[0][2])) and out[1] == pytest.approx(min(1 - 1e-6, got[-1][2])) and out[2] is None


def test_platt_equals_numpy_newton(spark):
    rng = np.random.default_rng(2)
    s = np.round(np.clip(rng.random(400), 0.01, 0.99), 2)
    y = (rng.random(400) < s).astype(int)
    z = np.log(s / (1 - s))
    w = np.zeros(2)
    x = np.c_[z, np.ones(400)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(1e6 * (x * (p * (1 - p))[:, None]).T @ x + np.diag([1, 0]), 1e6 * x.T @ (p - y) + [w[0], 0])
    assert calibrate.platt(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")) == pytest.approx(tuple(w), abs=1e-7)


def test_clips_of_several_shapes(spark, tmp_path):
    x = (np.sin(np.arange(50) / 3) * 0.5).round(3)
    wav = io.encode_wav(x, 8000)
    (tmp_path / "c").mkdir()
    (tmp_path / "c/f.wav").write_bytes(wav)
    path = f"file:{tmp_path}/c/f.wav"
    rows = [(1, (None, None, bytes(wav), None)), (2, ([float(v) for v in x], 16000, None, None)), (3, (None, None, None, path))]
    df = spark.createDataFrame(rows, "id int, audio struct<array:array<float>,sampling_rate:int,bytes:binary,path:string>")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/c")
    got = {r["id"]: r for r in io.decode_any(df, "audio", files).collect()}
    assert [got[i]["sr"] for i in (1, 2, 3)] == [8000, 16000, 8000] and all(np.allclose(got[i]["samples"], x, atol=1e-4) for i in got)
    with pytest.raises(Exception, match="neither"):
        io.decode_any(df, "audio").collect()


def test_a_stream_that_stops_goes_on_where_it_was(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [(u, e) for e in range(60) for u in [e % 3]]
    random.Random(4).shuffle(rows)
    for part in (rows[:30], rows[30:] + rows[:5]):  # some rows come again
        spark.createDataFrame(part, "u int, e long").write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema("u int, e long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = stateful.run_to_table(spark, source, lambda s: stateful.first_rows(s, "u", "e", 4), path)
        last = {r["key"]: r["items"] for r in out.collect()}
    assert last == {str(u): [u, u + 3, u + 6, u + 9] for u in range(3)}


def test_training_record():
    c = replay.TrainConfig()
    assert (c.lr, c.head_lr, c.epochs, c.batch_size, c.rehearsal_ratio, c.rank, c.alpha) == (1e-4, 1e-3, 5, 64, 0.5, 16, 32)


def test_streams_call_a_bucket_of_keys_at_once(spark, tmp_path, monkeypatch):
    """A trigger's cost is of its rows: many keys share a call, and a batch is worked out once."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    rows = [(u, (u * 7 + i * 13) % 50) for u in range(40) for i in range(9)]
    df = spark.createDataFrame(rows, "u long, e long")
    path = f"file://{tmp_path}/s"
    df.repartition(3).write.parquet(f"{path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = stateful.run_to_table(spark, source, lambda s: stateful.first_rows(s, "u", "e", 4), path).collect()
    want = {str(u): sorted({e for v, e in rows if v == u})[:4] for u in range(40)}
    assert {r["key"]: r["items"] for r in got} == want and len(got) == 40
    assert spark.read.parquet(f"{path}/batches/*").count() >= 40


def test_tree_is_listed_without_opening_its_files(spark, tmp_path):
    from sondera.sources import io

    for rel in ("authentic/n1_x.MP4", "piper/spk/deep/a b%.wav", "piper/.hidden/a.wav", "piper/_tmp.wav", "top.wav"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(b".")
    (tmp_path / "piper/empty.wav").write_bytes(b"")
    out = io.scan_tree(spark, f"file://{tmp_path}")
    assert "binaryFile" not in out._jdf.queryExecution().toString()
    assert sorted((r["path"], r["label"], r["source_id"]) for r in out.collect()) == [("authentic/n1_x.MP4", 0, "n1"), ("piper/spk/deep/a b%.wav", 1, "spk")]
