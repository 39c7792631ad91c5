"""Signal and image expressions against NumPy, and what they must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera.operators import images, signals


def applied(spark, rows, *cols):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, x array<double>")
    return [np.array(r["y"]) for r in df.select("id", *(c.alias("y") for c in cols)).orderBy("id").collect()]


def direct_filter(b, a, x):
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * y[i - k] for k in (1, 2) if i >= k)
    return y


def test_filters_equal_the_difference_equation(spark):
    rng = np.random.default_rng(0)
    clips = [rng.normal(size=n) for n in (0, 1, 63, 64, 65, 200)]
    b, a = signals.shelf_coefficients(16000)
    for got, x in zip(applied(spark, clips, signals.high_shelf(F.col("x"), 16000.0)), clips):
        assert np.allclose(got, direct_filter(b, a, x), atol=1e-12)
    for got, x in zip(applied(spark, clips, signals.bandpass(F.col("x"), 16000.0)), clips):
        want = x
        for section in signals.bandpass_sections(16000.0):
            want = direct_filter(*section, want)
        assert np.allclose(got, want, atol=1e-9)


def test_bandpass_passes_the_band(spark):
    t = np.arange(3200) / 16000
    x = np.sin(2 * np.pi * 1000 * t) + np.sin(2 * np.pi * 5000 * t)
    y = applied(spark, [x], signals.bandpass(F.col("x"), 16000.0))[0]
    power = lambda v, f: np.abs(np.fft.rfft(v))[int(f * len(v) / 16000)]
    assert power(y, 5000) < 0.1 * power(x, 5000) and power(y, 1000) > 0.7 * power(x, 1000)


def direct_resample(x, old, new):
    up, down, h = signals.polyphase(old, new)
    if not len(x):
        return np.zeros(0)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)[len(h) // 2 :][: len(wide)][::down]


@pytest.mark.parametrize("old, new", [(16000, 8000), (8000, 16000), (16000, 24000), (22050, 16000), (16000, 16000)])
def test_resampling_equals_a_convolution(spark, old, new):
    rng = np.random.default_rng(1)
    clips = [rng.normal(size=n) for n in (0, 1, 37, 150)]
    for got, x in zip(applied(spark, clips, signals.resample(F.col("x"), old, new)), clips):
        want = x if old == new else direct_resample(x, old, new)
        assert len(got) == -(-len(x) * new // old) and np.allclose(got, want, atol=1e-9)


def test_a_ramp_does_not_wrap_round(spark):
    y = applied(spark, [np.linspace(0, 1, 400)], signals.resample(F.col("x"), 16000, 8000))[0]
    assert np.allclose(y[20:-20], np.linspace(0, 1, 400)[::2][20:-20], atol=2e-3) and abs(y[0]) < 0.05


def test_mu_law_round_trip_and_codecs(spark):
    x = 0.4 * np.sin(np.arange(333) / 9)
    y = applied(spark, [x, []], signals.codec_roundtrip(F.col("x"), 16000))
    low = np.clip(direct_resample(x, 16000, 8000), -1, 1)
    comp = np.rint((np.sign(low) * np.log1p(255 * np.abs(low)) / np.log(256) + 1) / 2 * 255) / 255 * 2 - 1
    back = direct_resample(np.sign(comp) * np.expm1(np.abs(comp) * np.log(256)) / 255, 8000, 16000)
    assert len(y[0]) == 333 and np.allclose(y[0], back[:333], atol=1e-9) and len(y[1]) == 0
    with pytest.raises(ValueError):
        signals.codec_roundtrip(F.col("x"), 16000, "opus")


def test_room_keeps_level_and_length(spark):
    x = np.random.default_rng(2).normal(size=300)
    h = np.array(spark.range(1).select(signals.room_response(F.lit("r"), 1000, F.lit(0.2)).alias("h")).first()["h"])
    assert len(h) == 200 and h[0] == 1 and np.abs(h[1:]).max() == pytest.approx(0.35, abs=1e-6)
    assert len(spark.range(1).select(signals.room_response(F.lit("r"), 10, F.lit(0.1)).alias("h")).first()["h"]) == 8
    y = applied(spark, [x, [], [0.0, 0.0]], signals.convolved(F.col("x"), F.array(*(F.lit(float(v)) for v in h))))
    wet = np.convolve(x, h)[:300]
    assert np.allclose(y[0], wet * np.sqrt((x**2).mean() / (wet**2).mean()), atol=1e-9) and len(y[1]) == 0 and (y[2] == 0).all()


def test_telephone_is_repeatable_and_follows_its_recipe(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=40) / 4]) for i in range(12)], "id long, x array<double>")
    a, b = ({r["id"]: r for r in signals.telephone_channel(df, "id", "x", 800, 5).collect()} for _ in range(2))
    assert a == b and all(len(r["x"]) == 40 and "bandpass(300-3400)" in r["recipe"] for r in a.values())
    assert len({r["recipe"] for r in a.values()}) > 6
    # a filter on the samples finds what it should and takes no longer
    assert signals.telephone_channel(df, "id", "x", 800, 5).where(F.size("x") == 40).count() == 12
    dry = signals.telephone_channel(df, "id", "x", 800, 5, p_rir=0.0, p_codec=0.0, p_loss=0.0).collect()
    x = {r["id"]: np.array(r["x"]) for r in df.collect()}
    for r in dry:
        want = x[r["id"]]
        for section in signals.bandpass_sections(800):
            want = direct_filter(*section, want)
        assert np.allclose(r["x"], want, atol=1e-9) and r["recipe"] == "bandpass(300-3400)"


def numpy_requantised(block, quality):
    m = images.dct_matrix()
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    q = np.clip((np.array(images.STEPS_50) * scale + 50) // 100, 1, 255)
    return np.clip(np.rint(m.T @ (np.rint(m @ (block - 128) @ m.T / q) * q) @ m + 128), 0, 255)


def test_reencoding_equals_numpy_on_blocks(spark):
    x = np.random.default_rng(4).integers(0, 256, (16, 24)).astype(float)
    for quality in (25, 50, 95):
        got = applied(spark, [x.ravel()], images.reencoded(F.col("x"), 16, 24, F.lit(quality)))[0].reshape(16, 24)
        want = np.block([[numpy_requantised(x[r : r + 8, c : c + 8], quality) for c in range(0, 24, 8)] for r in range(0, 16, 8)])
        assert np.array_equal(got, want)
    with pytest.raises(ValueError):
        images.reencoded(F.col("x"), 10, 8, F.lit(50))


def test_error_rises_as_quality_falls(spark):
    x = np.random.default_rng(5).integers(0, 256, (8, 8)).astype(float).ravel()
    df = spark.createDataFrame([(1, x.tolist())], "id long, x array<double>")
    rows = {r["quality"]: np.sqrt(((np.array(r["x"]) - x) ** 2).mean()) for r in images.sweep(df, "id", "x", 8, 8).collect()}
    ordered = [rows[q] for q in sorted(rows, reverse=True)]
    assert sorted(rows, reverse=True) == list(images.QUALITIES) and ordered == sorted(ordered)


def test_pixel_operators_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 256, (20, 16)).astype(float)
    row = lambda c: applied(spark, [x.ravel()], c)[0]
    n, r = 3, 1.2
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / r) ** 2)
    k /= k.sum()
    want = x
    for axis in (0, 1):
        p = np.pad(want, [(n, n) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        want = sum(v * np.take(p, np.arange(i, i + x.shape[axis]), axis=axis) for i, v in enumerate(k))
    assert np.allclose(row(images.blurred(F.col("x"), 20, 16, F.lit(r))).reshape(20, 16), want)
    mean = np.rint(x.mean())
    assert np.allclose(row(images.contrasted(F.col("x"), F.lit(1.2))), np.clip(mean + (x.ravel() - mean) * 1.2, 0, 255))
    noisy = row(images.noisy(F.col("x"), F.lit(5.0), F.lit("k")))
    assert (noisy == np.floor(noisy)).all() and 2 < np.abs(noisy - x.ravel()).mean() < 7
    field = np.floor(np.clip(x + np.sin(np.arange(16) * 2 * np.pi / 3.0) * 4, 0, 255))
    assert np.array_equal(row(images.moire(F.col("x"), 16, F.lit(3.0), F.lit(4.0))).reshape(20, 16), field)
    same = row(images.rescaled(F.col("x"), 20, 16, F.lit(1.0)))
    assert np.allclose(same, x.ravel()) and len(row(images.rescaled(F.col("x"), 20, 16, F.lit(0.5)))) == 320
    flat = applied(spark, [np.full(320, 7.0)], images.rescaled(F.col("x"), 20, 16, F.lit(0.4)))[0]
    assert np.allclose(flat, 7.0)


def test_saturation_of_colour_and_grey(spark):
    rgb = np.random.default_rng(7).integers(0, 256, (3, 64)).astype(float)
    grey = np.array([0.299, 0.587, 0.114]) @ rgb
    got = applied(spark, [rgb.ravel(), rgb[0]], images.saturated(F.col("x"), 64, F.lit(0.5)))
    assert np.allclose(got[0].reshape(3, 64), np.clip(grey + (rgb - grey) * 0.5, 0, 255)) and np.array_equal(got[1], rgb[0])


def _changes(recipe):
    """Whether any step does something to 8 x 8 pixels, which no rescale makes smaller."""
    return any(not step.startswith(("severity", "rescale")) for step in recipe.split("|"))


def test_degraded_images_follow_their_recipes(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, rng.integers(0, 256, 192).astype(float).tolist()) for i in range(20)], "id long, x array<double>")
    out = images.degraded(df, "id", "x", 8, 8, 1, p_screenshot=0.3).collect()
    said = {r["id"]: r["recipe"] for r in images.recipes(df, "id", 1, p_screenshot=0.3).collect()}
    before = {r["id"]: r["x"] for r in df.collect()}
    assert all(said[r["id"]] == r["recipe"] and len(r["x"]) == 192 and min(r["x"]) >= 0 and max(r["x"]) <= 255 for r in out)
    assert any("screenshot_sim" in v for v in said.values()) and all(_changes(r["recipe"]) == (r["x"] != before[r["id"]]) for r in out)


def test_room_response_by_its_first_samples_has_the_peak_of_all(spark):
    rows = spark.createDataFrame([(f"0|{i}", 0.15 + 0.05 * i) for i in range(8)], "seed string, rt double")
    whole, head = (signals.room_response(F.col("seed"), 16000, F.col("rt"), *a) for a in ((), (F.lit(80),)))
    for r in rows.select(whole.alias("whole"), head.alias("head")).collect():
        assert len(r["head"]) == 81 < len(r["whole"]) and r["head"] == r["whole"][:81]
