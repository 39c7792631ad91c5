"""Shortcut audit, signal, head and probe queries; a vector stands for a short clip."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import quality_bucket
from ..operators import images, lsh, order, probes, replay
from ..operators import signals as G
from ..sources import io, scratch
from .registry import Registry, r6, rounded
from .views import table

registry = Registry()
SR = 400  # 20 ms are 8 samples of a vector's 64
_X = "list_transform(embedding, lambda x: x::DOUBLE)"
_RMS = f"sqrt(list_sum(list_transform({_X}, lambda x: x * x)) / len(embedding))"
_PEAK = f"list_max(list_transform({_X}, lambda x: abs(x)))"


def clips(spark, sf):
    return table(spark, sf, "embeddings")


@registry("shc1_clip_features", f"SELECT vec_id, round({_PEAK}, 6) AS peak, round({_RMS}, 6) AS rms, round(len(embedding) / 400.0::DOUBLE, 6) AS seconds FROM embeddings")
def shc1(spark, sf):
    x = F.col("embedding")
    return clips(spark, sf).select("vec_id", r6(G.peak(x), "peak"), r6(G.rms(x), "rms"), r6(G.duration(x, SR), "seconds"))


_QUIET = f"len(list_filter(range(0, 8), lambda i: sqrt(list_sum(list_transform(list_slice({_X}, i * 8 + 1, i * 8 + 8), lambda x: x * x)) / 8) < 0.55::DOUBLE * {_RMS})) / 8.0::DOUBLE"


@registry("shc2_silence_fraction", f"SELECT vec_id, round({_QUIET}, 6) AS silence FROM embeddings")
def shc2(spark, sf):
    return clips(spark, sf).select("vec_id", r6(G.silence_fraction(F.col("embedding"), SR, share=0.55), "silence"))


_POWER = "[list_sum([x[i + 1] * cos(2 * pi() * k * i / 64) for i in range(64)]) ** 2 + list_sum([x[i + 1] * sin(2 * pi() * k * i / 64) for i in range(64)]) ** 2 for k in range({a}, {b})]"


@registry("shc3_band_fraction", f"SELECT vec_id, round(list_sum({_POWER.format(a=16, b=24)}) / list_sum({_POWER.format(a=0, b=33)}), 6) AS share FROM (SELECT vec_id, {_X} AS x FROM embeddings)")
def shc3(spark, sf):
    return clips(spark, sf).select("vec_id", r6(G.band_fraction(SR, 100.0, 150.0)("embedding"), "share"))


@registry("shc4_axis_report", f"SELECT label, round(quantile_cont({_PEAK}, 0.5), 6) AS med, round(min({_PEAK}), 6) AS lo, round(max({_PEAK}), 6) AS hi FROM embeddings GROUP BY 1")
def shc4(spark, sf):
    p = G.peak(F.col("embedding"))
    return rounded(order.quantiles(clips(spark, sf).select("label", p.alias("peak")), ["label"], "peak", {"med": 0.5}).select("label", "med", "lo", "hi"), "med", "lo", "hi")


@registry(
    "shc5_balanced_accuracy",
    """WITH v AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS x FROM lineitem), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
h AS (SELECT x, count(*) FILTER (y = 0) AS n, count(*) FILTER (y = 1) AS p FROM v GROUP BY 1), t AS (SELECT lo + i * ((hi - lo) / 800) AS t FROM e, (SELECT unnest(range(801)) AS i)),
a AS (SELECT t, (sum(n) FILTER (x < t) / sum(n) + sum(p) FILTER (x >= t) / sum(p)) / 2 AS acc FROM t, h GROUP BY t)
SELECT round(greatest(0.5::DOUBLE, max(acc), max(1 - acc)), 6) AS balanced, '' AS flag FROM a""",
)
def shc5(spark, sf):
    df = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_quantity").alias("x"))
    return rounded(G.best_balanced_accuracy(df, "y", "x"), "balanced")


@registry("sig1_loudness_normalise", f"SELECT vec_id, round({_PEAK} * 0.05::DOUBLE / {_RMS}, 6) AS peak_after FROM embeddings")
def sig1(spark, sf):
    return clips(spark, sf).select("vec_id", r6(G.peak(G.normalise_rms(F.col("embedding"), 0.05)), "peak_after"))


@registry("sig1_loudness_preflight", f"SELECT count(*) AS clips, count(*) FILTER ({_PEAK} / {_RMS} * 0.4::DOUBLE > 0.99::DOUBLE) AS too_hot FROM embeddings")
def sig1p(spark, sf):
    return G.loudness_preflight(clips(spark, sf), "embedding", 0.4)


def _filtered_sql(sections, source: str = "embeddings") -> str:
    """CTE f(vec_id, i, y): the clips' samples through the sections, a row of state carried a sample."""
    n = len(sections)
    zeros = ", ".join(f"0::DOUBLE AS p{k}, 0::DOUBLE AS q{k}" for k in range(n))
    cols, x = [], "v"
    for k, (b, a) in enumerate(sections):
        b0, b1, b2, a1, a2 = (f"{float(c)!r}::DOUBLE" for c in (*b, *a[1:]))
        cols += [f"{b0} * {x} + p{k} AS y{k}", f"{b1} * {x} - {a1} * ({b0} * {x} + p{k}) + q{k} AS np{k}", f"{b2} * {x} - {a2} * ({b0} * {x} + p{k}) AS nq{k}"]
        x = f"y{k}"
    state = ", ".join(f"np{k}, nq{k}" for k in range(n))
    names = ", ".join(f"p{k}, q{k}" for k in range(n))
    return f"""f AS (WITH RECURSIVE r(vec_id, x, i, y, {names}) AS (SELECT vec_id, {_X} AS x, 0, NULL::DOUBLE, {zeros} FROM {source}
UNION ALL SELECT vec_id, x, i + 1, y{n - 1}, {state} FROM (SELECT *, {', '.join(cols)} FROM (SELECT *, x[i + 1] AS v FROM r WHERE i < len(x)))) SELECT vec_id, i - 1 AS i, y FROM r WHERE i > 0)"""


def samples_of(df, samples: str = "embedding"):
    """vec_id, i, y: each sample to five places."""
    return df.select("vec_id", F.posexplode(samples).alias("i", "y")).withColumn("y", F.round("y", 5))


_F0 = "(100 + 150 * l_quantity)"
_COOK = f"""WITH q AS (SELECT DISTINCT {_F0}::DOUBLE AS f0 FROM lineitem), p AS (SELECT f0, pow(10::DOUBLE, -12 / 40.0::DOUBLE) AS g, 2 * pi() * f0 / 16000 AS w FROM q),
c AS (SELECT f0, g, cos(w) AS c, 2 * sqrt(g) * (sin(w) / 2 * sqrt(2::DOUBLE)) AS r FROM p), d AS (SELECT *, (g + 1) - (g - 1) * c + r AS a0 FROM c)
SELECT f0, round(g * ((g + 1) + (g - 1) * c + r) / a0, 6) AS b0, round(-2 * g * ((g - 1) + (g + 1) * c) / a0, 6) AS b1, round(g * ((g + 1) + (g - 1) * c - r) / a0, 6) AS b2,
round(2 * ((g - 1) - (g + 1) * c) / a0, 6) AS a1, round(((g + 1) - (g - 1) * c - r) / a0, 6) AS a2 FROM d"""


@registry("sig2_shelf_coefficients", _COOK)
def sig2(spark, sf):
    f0 = table(spark, sf, "lineitem").select((100 + 150 * F.col("l_quantity")).cast("double").alias("f0")).distinct()
    b, a = G.shelf_columns(F.lit(16000.0), F.col("f0"))
    return f0.select("f0", *(r6(x, f"b{i}") for i, x in enumerate(b)), *(r6(x, f"a{i + 1}") for i, x in enumerate(a)))


@registry("sig2_channel_equalise", f"WITH {_filtered_sql([G.shelf_coefficients(16000.0)])} SELECT vec_id, i::INT AS i, round(y, 5) AS y FROM f")
def sig2_eq(spark, sf):
    return samples_of(clips(spark, sf).select("vec_id", G.high_shelf(F.col("embedding"), 16000.0).alias("embedding")))


def _resampled_sql(x: str, old: int, new: int) -> str:
    up, down, h = G.polyphase(old, new)
    half, lit = len(h) // 2, "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in h) + "]"
    inner = f"list_sum([{x}[j + 1] * {lit}[{half} + k * {down} - j * {up} + 1] for j in range(len({x})) if {half} + k * {down} - j * {up} between 0 and {2 * half}])"
    return f"[{inner} for k in range(ceil(len({x}) * {up} / {down}.0)::BIGINT)]"


def _mu(x: str) -> str:
    y = f"(sign({x}) * ln(1 + 255 * abs({x})) / ln(256))"
    q = f"(round_even(({y} + 1) / 2 * 255, 0) / 255 * 2 - 1)"
    return f"(sign({q}) * (exp(abs({q}) * ln(256)) - 1) / 255)"


@registry("sig3_mu_law_compand", f"SELECT vec_id, round(list_sum(list_transform({_X}, lambda x: {_mu('x')})), 5) AS total FROM embeddings")
def sig3(spark, sf):
    return clips(spark, sf).select("vec_id", F.round(F.aggregate(G.mu_law_clip(F.col("embedding")), F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@registry("sig6_packet_loss", "SELECT vec_id, sum(CASE WHEN CAST(CAST(('0x' || substr(md5('0|' || vec_id || '|' || f), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE < 0.3 THEN 1 ELSE 0 END)::BIGINT * 8 AS lost FROM embeddings, (SELECT unnest(range(8)) AS f) GROUP BY 1")
def sig6(spark, sf):
    out = G.packet_loss(F.col("vec_id"), F.col("embedding"), SR, 0.3)
    return clips(spark, sf).select("vec_id", F.size(F.filter(out, lambda v: v == 0)).cast("long").alias("lost"))


_R = f"WITH d AS (SELECT vec_id, {_X} AS x FROM embeddings), n AS (SELECT vec_id, len(x) AS len0, {_resampled_sql('x', 16000, 8000)} AS x FROM d)"


@registry("sig3_mu_law_roundtrip", f"{_R}, c AS (SELECT vec_id, len0, [{_mu('greatest(-1, least(1, v))')} for v in x] AS x FROM n), b AS (SELECT vec_id, len0, {_resampled_sql('x', 8000, 16000)} AS x FROM c) SELECT vec_id, unnest(range(len0::INT))::INT AS i, round(unnest([coalesce(x[i], 0) for i in range(1, len0 + 1)]), 5) AS y FROM b")
def sig3_trip(spark, sf):
    return samples_of(clips(spark, sf).select("vec_id", G.codec_roundtrip(F.col("embedding"), 16000).alias("embedding")))


def _u(what: str, key: str = "vec_id") -> str:
    return f"(CAST(('0x' || substr(md5('{what}|' || {key}), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


@registry(
    "sig9_recipes",
    f"""SELECT vec_id, concat_ws('|', CASE WHEN {_u('0|rir')} < 0.5 THEN printf('rir(rt60=%.2f,synthetic)', 0.15::DOUBLE + 0.45::DOUBLE * {_u('0|rt60')}) END, 'bandpass(300-3400)', CASE WHEN {_u('0|codec')} < 0.9 THEN 'g711_mulaw' END,
CASE WHEN {_u('0|loss')} < 0.7 THEN printf('ploss(rate=%.3f,burst=%dms)', 0.02::DOUBLE + 0.08::DOUBLE * {_u('0|rate')}, CASE WHEN {_u('0|burst')} < 0.5 THEN 20 ELSE 40 END) END) AS recipe FROM embeddings""",
)
def sig9_recipes(spark, sf):
    return clips(spark, sf).select("vec_id", G.telephone_recipe(F.col("vec_id"))["text"].alias("recipe"))


@registry("sig9_telephone_channel")
def sig9(spark, sf):
    # a clip is much work and a file has many: dealt out over the cores
    rows = clips(spark, sf).repartition(2 * spark.sparkContext.defaultParallelism, "vec_id")
    return G.telephone_channel(rows, "vec_id", "embedding", 16000)


@registry("sig5_bandpass", f"WITH {_filtered_sql(G.bandpass_sections(16000.0))} SELECT vec_id, i::INT AS i, round(y, 5) AS y FROM f")
def sig5(spark, sf):
    return samples_of(clips(spark, sf).select("vec_id", G.bandpass(F.col("embedding"), 16000.0).alias("embedding")))


_NORMAL = "sqrt(-2 * ln(1 - " + _u("u|' || 'room' || '|' || k || '", "''").replace("|' || '')", "')") + ")) * cos(2 * pi() * " + _u("v|' || 'room' || '|' || k || '", "''").replace("|' || '')", "')") + ")"


@registry(
    "sig8_room_response",
    f"""WITH t AS (SELECT k, {_NORMAL} * exp(-6.908::DOUBLE * (k / 16000.0::DOUBLE) / 0.3::DOUBLE) AS v FROM (SELECT unnest(range(1, 4800)) AS k)),
h AS (SELECT list_concat([1.0::DOUBLE], list(0.35::DOUBLE * v / ((SELECT max(abs(v)) FROM t) + 1e-9::DOUBLE) ORDER BY k)) AS h FROM t),
d AS (SELECT vec_id, {_X} AS x FROM embeddings), w AS (SELECT vec_id, x, [list_sum([x[i - j + 1] * h[j] for j in range(1, i + 1)]) for i in range(1, len(x) + 1)] AS y FROM d, h),
g AS (SELECT vec_id, y, sqrt(list_sum([v * v for v in x]) / len(x)) / sqrt(list_sum([v * v for v in y]) / len(y)) AS g FROM w)
SELECT vec_id, unnest(range(len(y)::INT))::INT AS i, round(unnest([v * g for v in y]), 5) AS y FROM g""",
)
def sig8(spark, sf):
    response = table(spark, sf, "region").agg(G.room_response(F.lit("room"), 16000, F.lit(0.3)).alias("h"))
    return samples_of(clips(spark, sf).crossJoin(F.broadcast(response)).select("vec_id", G.convolved(F.col("embedding"), F.col("h")).alias("embedding")))


@registry("sig11_resample", f"{_R} SELECT vec_id, unnest(range(len(x)::INT))::INT AS i, round(unnest(x), 5) AS y FROM n")
def sig11(spark, sf):
    return samples_of(clips(spark, sf).select("vec_id", G.resample(F.col("embedding"), 16000, 8000).alias("embedding")))


@registry("sig11_resample_ratio", f"WITH d AS (SELECT vec_id, {_X} AS x FROM embeddings), n AS (SELECT vec_id, {_resampled_sql('x', 16000, 24000)} AS x FROM d) SELECT vec_id, unnest(range(len(x)::INT))::INT AS i, round(unnest(x), 5) AS y FROM n")
def sig11_ratio(spark, sf):
    return samples_of(clips(spark, sf).select("vec_id", G.resample(F.col("embedding"), 16000, 24000).alias("embedding")))


def pixels(spark, sf):
    """vec_id, pixels: a vector's 64 numbers as an 8 x 8 block of grey."""
    grey = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * v.cast("double")))).cast("double")
    return clips(spark, sf).select("vec_id", F.transform("embedding", grey).alias("pixels"))


_PIXELS = f"SELECT vec_id, [floor(greatest(0, least(255, 128 + 400 * v)))::DOUBLE for v in {_X}] AS x FROM embeddings"
_DCT = "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in images.dct_matrix().ravel()) + "]"
_IDCT = "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in images.dct_matrix().T.ravel()) + "]"
_STEPS = "[" + ", ".join(str(v) for row in images.STEPS_50 for v in row) + "]"


def _product(m: str, x: str) -> list[str]:
    return [f"[list_sum([({m})[p // 8 * 8 + i + 1] * {x}[i * 8 + p % 8 + 1] for i in range(8)]) for p in range(64)]", f"[list_sum([{x}[p // 8 * 8 + j + 1] * ({m})[p % 8 * 8 + j + 1] for j in range(8)]) for p in range(64)]"]


def _requantised(source: str, quality: str, keep: str) -> str:
    """source (keep, x) re-encoded, as (keep, x)."""
    one, two = _product(_DCT, "x")
    three, four = _product(_IDCT, "x")
    scale = f"(CASE WHEN {quality} < 50 THEN floor(5000 / {quality}) ELSE 200 - 2 * {quality} END)"
    source = f"(SELECT {keep}, [v - 128 for v in x] AS x FROM {source})"
    for step in (one, two, f"[round_even(x[p] / q[p], 0) * q[p] for p in range(1, 65)]", three, four):
        steps = f", [greatest(1, least(255, floor((b * {scale} + 50) / 100))) for b in {_STEPS}] AS q" if "round_even" in step else ""
        source = f"(SELECT {keep}, {step} AS x FROM (SELECT *{steps} FROM {source}))"
    return f"(SELECT {keep}, [greatest(0, least(255, round_even(v + 128, 0))) for v in x] AS x FROM {source})"


@registry(
    "img9_quality_sweep",
    f"""WITH d AS ({_PIXELS}), r AS {_requantised(f"(SELECT vec_id, x, unnest([{', '.join(map(str, images.QUALITIES))}]) AS quality FROM d)", 'quality', 'vec_id, quality')}
SELECT vec_id, quality, CASE WHEN quality >= 90 THEN 'q_high' WHEN quality >= 65 THEN 'q_mid' ELSE 'q_low' END AS bucket, round(sqrt(list_sum([(r.x[i] - d.x[i]) ** 2 for i in range(1, 65)]) / 64), 5) AS rmse FROM r JOIN d USING (vec_id)""",
)
def img9(spark, sf):
    before = pixels(spark, sf)
    after = images.sweep(before, "vec_id", "pixels", 8, 8).withColumnRenamed("pixels", "after")
    err = F.aggregate(F.zip_with("after", "pixels", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return after.join(before, "vec_id").select("vec_id", "quality", quality_bucket(F.col("quality")).alias("bucket"), F.round(F.sqrt(err / 64), 5).alias("rmse"))


@registry(
    "img7_screenshot",
    f"""WITH d AS ({_PIXELS}), m AS (SELECT vec_id, [floor(greatest(0, least(255, x[p + 1] + sin((p % 8) * 2 * pi() / 3.5::DOUBLE) * 4)))::DOUBLE for p in range(64)] AS x FROM d), r AS {_requantised('m', '70', 'vec_id')}
SELECT vec_id, unnest(range(64))::INT AS i, unnest(x)::DOUBLE AS y FROM r""",
)
def img7(spark, sf):
    # a block is as small as a rescale may get, so that step leaves it alone
    shot = images.screenshot(F.col("pixels"), 8, 8, F.lit(3.5), F.lit(4.0), F.lit(0.8), F.lit(70))
    return pixels(spark, sf).select("vec_id", F.posexplode(shot).alias("i", "y"))


def _recipe_sql() -> str:
    u = lambda what: _u(f"0|{what}")
    of = lambda what, i: f"(CASE WHEN {u('severity')} < 0.4 THEN {images.SEVERITIES['light'][what][i]} WHEN {u('severity')} < 0.8 THEN {images.SEVERITIES['medium'][what][i]} ELSE {images.SEVERITIES['heavy'][what][i]} END)::DOUBLE"
    between = lambda what, op: f"({of(what, 0)} + ({of(what, 1)} - {of(what, 0)}) * {u('p|' + op)})"
    enhance = lambda op: f"({images.ENHANCE[0]}::DOUBLE + ({images.ENHANCE[1]}::DOUBLE - {images.ENHANCE[0]}::DOUBLE) * {u('p|' + op)})"
    k = f"({of('k', 0)} + floor({u('k')} * ({of('k', 1)} - {of('k', 0)} + 1)))::BIGINT"
    shown = {"jpeg": ("jpeg(q=%.0f)", f"floor({between('jpeg', 'jpeg')})"), "rescale": ("rescale(%.2f)", between("rescale", "rescale")), "blur": ("blur(%.2f)", between("blur", "blur")), "noise": ("noise(%.1f)", between("noise", "noise")), "contrast": ("contrast(%.2f)", enhance("contrast")), "saturation": ("sat(%.2f)", enhance("saturation")), "jpeg2": ("jpeg(q=%.0f)", f"floor({between('jpeg', 'jpeg2')})")}
    rows = " UNION ALL ".join(f"SELECT vec_id, '{m}' AS m, {u('order|' + m)} AS o, {k} AS k, {p} AS p, printf('{t}', {p}) AS text FROM embeddings" for m, (t, p) in shown.items())
    return f"""WITH a AS ({rows}), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY o) AS r FROM a),
c AS (SELECT vec_id, string_agg(text, '|' ORDER BY m = 'jpeg2', o) AS text FROM b WHERE r <= k AND NOT (m = 'blur' AND p <= 0.05) AND NOT (m = 'noise' AND p <= 0.1) GROUP BY 1)
SELECT vec_id, s AS severity, concat_ws('|', 'severity=' || s, CASE WHEN {u('screenshot')} < 0.1 THEN 'screenshot_sim' END, c.text) AS recipe
FROM (SELECT vec_id, CASE WHEN {u('severity')} < 0.4 THEN 'light' WHEN {u('severity')} < 0.8 THEN 'medium' ELSE 'heavy' END AS s FROM embeddings) LEFT JOIN c USING (vec_id)"""


@registry("img_degradation_recipes", _recipe_sql())
def img8(spark, sf):
    return images.recipes(clips(spark, sf).select("vec_id"), "vec_id")


@registry("img_pixel_operators")
def img2(spark, sf):
    rows = pixels(spark, sf).repartition(2 * spark.sparkContext.defaultParallelism, "vec_id")
    return images.degraded(rows, "vec_id", "pixels", 8, 8)


@registry("sig10_zero_mean_unit_var", f"SELECT vec_id, unnest(range(len(embedding)::INT))::INT AS i, round(unnest([(v - list_avg({_X})) / sqrt(list_var_pop({_X}) + 1e-7) for v in {_X}]), 5) AS y FROM embeddings")
def sig10(spark, sf):
    return samples_of(clips(spark, sf).select("vec_id", G.zero_mean_unit_var(F.col("embedding")).alias("embedding")))


_ROWS8 = "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in images.dct_matrix(32)[:8].ravel()) + "]"


@registry(
    "dat4_phash",
    f"""WITH g AS (SELECT vec_id // 16 AS image, flatten(list({_X} ORDER BY vec_id)) AS x FROM embeddings GROUP BY 1 HAVING count(*) = 16),
h AS (SELECT image, [list_sum([({_ROWS8})[p // 32 * 32 + i + 1] * x[i * 32 + p % 32 + 1] for i in range(32)]) for p in range(256)] AS h FROM g),
l AS (SELECT image, [list_sum([h[p // 8 * 32 + j + 1] * ({_ROWS8})[p % 8 * 32 + j + 1] for j in range(32)]) for p in range(1, 64)] AS l FROM h)
SELECT image, list_sum([CASE WHEN l[i + 1] > list_median(l) THEN 1::BIGINT << i ELSE 0 END for i in range(63)])::BIGINT AS hash FROM l""",
)
def dat4(spark, sf):
    # 16 vectors one after another are the 1,024 pixels of an image, so every number of every vector counts
    rows = clips(spark, sf).groupBy(F.floor(F.col("vec_id") / 16).alias("image")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda v: v["embedding"])).alias("pixels"))
    return rows.where(F.size("pixels") == 1024).select("image", lsh.phash("pixels").alias("hash"))


_W = [[1.0 if i % 2 == c else 0.25 for i in range(64)] for c in (0, 1)]


def _cos(w: list[float]) -> str:
    n = sum(v * v for v in w) ** 0.5
    lit = "[" + ", ".join(f"{v / n!r}::DOUBLE" for v in w) + "]"
    return f"round(16 * list_dot_product({_X}, {lit}) / sqrt(list_dot_product({_X}, {_X})), 6)"


@registry("ft2_cosine_head", f"SELECT vec_id, {_cos(_W[0])} AS logit_0, {_cos(_W[1])} AS logit_1 FROM embeddings")
def ft2(spark, sf):
    out = replay.cosine_scores(clips(spark, sf), "embedding", _W)
    return out.select("vec_id", r6(F.col("logits")[0], "logit_0"), r6(F.col("logits")[1], "logit_1"))


#: the layers that are probed, and how a layer's vectors come from the stored ones
LAYERS = (0, 2, 4, 6, 8, 10, 12)


def layered(spark, sf):
    """path, layer, y, split, vec: a vector mixes each number with that `layer` places on."""
    v = F.col("embedding").cast("array<double>")
    mixed = lambda n: F.transform(v, lambda x, i: x * F.lit(float(np.cos(n / 8))) + F.element_at(v, ((i + n) % F.size(v) + 1).cast("int")) * F.lit(float(np.sin(n / 8))) * (1 + 0.1 * F.abs(x)))
    split = F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "val").otherwise("test")
    rows = clips(spark, sf).select(F.col("vec_id").alias("path"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"), split.alias("split"), F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), mixed(n).alias("vec")) for n in LAYERS))).alias("l"))
    return rows.select("path", "l.layer", "y", "split", "l.vec")


_ODDS = " UNION ALL ".join(
    f"SELECT vec_id AS path, {n} AS layer, (label >= 5)::INT AS y, CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, "
    f"[{float(np.cos(n / 8))!r}::DOUBLE * v[i] + {float(np.sin(n / 8))!r}::DOUBLE * v[(i - 1 + {n}) % 64 + 1] * (1 + 0.1::DOUBLE * abs(v[i])) for i in range(1, 65)] AS vec FROM (SELECT vec_id, label, {_X} AS v FROM embeddings)"
    for n in LAYERS
)
_CENTROID = f"""l AS ({_ODDS}), d AS (SELECT layer, i, avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0) AS d FROM (SELECT layer, y, unnest(vec) AS x, unnest(range(64)) AS i FROM l WHERE split = 'train') GROUP BY ALL),
w AS (SELECT layer, list(d ORDER BY i) AS w FROM d GROUP BY 1), s AS (SELECT layer, split, y, list_dot_product(vec, w) AS s FROM l JOIN w USING (layer) WHERE split <> 'train'),
c AS (SELECT *, sum(1 - y) OVER (PARTITION BY layer, split ORDER BY s) AS cn, count(*) OVER (PARTITION BY layer, split, s, y) AS t FROM s),
a AS (SELECT layer, split, sum(CASE WHEN y = 1 THEN cn - 0.5::DOUBLE * (SELECT count(*) FROM s z WHERE z.layer = c.layer AND z.split = c.split AND z.s = c.s AND z.y = 0) END) / (sum(y)::DOUBLE * sum(1 - y)) AS auc FROM c GROUP BY ALL),
g AS (SELECT layer, round(max(auc) FILTER (split = 'val'), 6) AS val_auc, round(max(auc) FILTER (split = 'test'), 6) AS test_auc, round(max(auc) FILTER (split = 'val') - max(auc) FILTER (split = 'test'), 6) AS gap FROM a GROUP BY 1)"""


def probed(spark, sf):
    rows = layered(spark, sf)
    return probes.report(probes.scored(rows.where("split <> 'train'"), probes.fit(rows.where("split = 'train'"), 64)))


@registry("prb1_linear_probe")
def prb1(spark, sf):
    return rounded(probed(spark, sf), "val_auc", "val_eer", "val_tpr", "test_auc", "test_eer", "test_tpr", "gap")


@registry("prb3_layer_gap", f"WITH {_CENTROID} SELECT layer, val_auc, test_auc, gap FROM g")
def prb3(spark, sf):
    return rounded(probes.report(probes.centroid_scored(layered(spark, sf))).select("layer", "val_auc", "test_auc", "gap"), "val_auc", "test_auc", "gap")


@registry("prb3_layer_choice")
def prb3_choice(spark, sf):
    return probes.choice(rounded(probed(spark, sf), "val_auc", "test_auc", "gap"))


@registry("prb6_probe_gate", f"WITH {_CENTROID} SELECT layer, val_auc, test_auc, coalesce(val_auc >= 0.5 AND test_auc >= 0.48, false) AS passed FROM g")
def prb6(spark, sf):
    # this data's classes are as good as chance, so the gate is put where layers pass and fail
    table = rounded(probes.report(probes.centroid_scored(layered(spark, sf))), "val_auc", "test_auc")
    return probes.gated(table, 0.5, 0.48).select("layer", "val_auc", "test_auc", "passed")


@registry("io7_feature_store", f"WITH l AS ({_ODDS}) SELECT path, layer, round(list_sum(vec), 5) AS total FROM l WHERE layer IN (4, 6)")
def io7(spark, sf):
    with scratch.folder(spark, "features") as store:
        io.write_vectors(layered(spark, sf).select("path", "layer", "vec"), store)
        total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
        return scratch.kept(io.read_vectors(spark, store, [4, 6]).select("path", "layer", F.round(total, 5).alias("total")), "features-read")


@registry("io8_wav_round_trip", f"SELECT 'clip_' || vec_id || '.wav' AS name, 16000 AS sr, unnest(range(len(embedding)::INT))::INT AS i, round(unnest([greatest(-32768, least(32767, round_even(v * 32768, 0))) / 32768.0::DOUBLE for v in {_X}]), 5) AS y FROM embeddings")
def io8(spark, sf):
    with scratch.folder(spark, "wav") as path:
        io.write_wav(clips(spark, sf).select(F.format_string("clip_%d.wav", "vec_id").alias("name"), F.lit(16000).alias("sr"), F.col("embedding").alias("samples")), path)
        back = io.read_wav(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sr", F.posexplode("samples").alias("i", "y"))
        return scratch.kept(back.withColumn("y", F.round(F.col("y").cast("double"), 5)), "wav-read")
