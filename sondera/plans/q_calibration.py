"""Calibration and open-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calibrate as C
from .registry import Registry, r6, rounded
from .views import LINES_SQL, lines

registry = Registry()


def _clip(x: str, eps: str = "1e-6") -> str:
    return f"greatest({eps}::DOUBLE, least(1 - {eps}::DOUBLE, {x}))"


def _logit(x: str, eps: str = "1e-6") -> str:
    p = _clip(x, eps)
    return f"ln({p} / (1 - {p}))"


def _sig(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-abs({z}))) ELSE exp(-abs({z})) / (1 + exp(-abs({z}))) END)"


def _grid(lo: float, hi: float, n: int) -> str:
    return f"(SELECT {lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * i / {n - 1} AS t FROM (SELECT unnest(range({n})) AS i))"


def _temperature(points: str, grid: str, group: str = "") -> str:
    """points: (group, z, y, k)."""
    p = _clip(_sig("(z / t)"))
    g = f"{group}, " if group else ""
    return f"""SELECT {g}min({{'nll': nll, 't': t}}) AS b FROM (SELECT {g}t, sum(-(y * ln({p}) + (1 - y) * ln(1 - {p})) * k) / sum(k) AS nll FROM {points}, {grid} GROUP BY {g}t) GROUP BY {group or 'ALL'}"""


def _points(group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"(SELECT {g}{_logit('prob')} AS z, label::DOUBLE AS y, count(*) AS k FROM {LINES_SQL} v GROUP BY ALL)"


@registry("cal1_logit_sigmoid", f"SELECT id, round({_logit('prob')}, 6) AS z, round({_sig(_logit('prob'))}, 6) AS p FROM {LINES_SQL} v")
def cal1(spark, sf):
    z = S.logit(F.col("prob"))
    return lines(spark, sf).select("id", r6(z, "z"), r6(S.sigmoid(z), "p"))


@registry("cal2_temperature", f"WITH b AS ({_temperature(_points(), _grid(0.05, 10.0, 400))}) SELECT round(b.t, 6) AS temperature, round(b.nll, 6) AS nll FROM b")
def cal2(spark, sf):
    return rounded(C.temperature(lines(spark, sf), score="prob"), "temperature", "nll")


_P = "(1 / (1 + exp(-(a * z + b))))"
_PLATT = f"""pts AS {_points()}, fit AS (WITH RECURSIVE r(i, a, b) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
SELECT i + 1, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (SELECT i, a, b, 1e6::DOUBLE * sum(k * ({_P} - y) * z) + a AS ga, 1e6::DOUBLE * sum(k * ({_P} - y)) AS gb,
1e6::DOUBLE * sum(k * {_P} * (1 - {_P}) * z * z) + 1 AS aa, 1e6::DOUBLE * sum(k * {_P} * (1 - {_P}) * z) AS ab, 1e6::DOUBLE * sum(k * {_P} * (1 - {_P})) AS bb FROM r, pts WHERE i < 12 GROUP BY i, a, b)) SELECT a, b FROM r WHERE i = 12)"""


_PLATT_Z = f"(a * {_logit('prob')} + b)"


@registry("cal3_platt", f"WITH {_PLATT} SELECT id, round({_sig(_PLATT_Z)}, 6) AS prob FROM {LINES_SQL} v, fit")
def cal3(spark, sf):
    df = lines(spark, sf)
    a, b = C.platt(df, score="prob")
    return df.select("id", F.round(S.sigmoid(a * S.logit(F.col("prob")) + b), 6).alias("prob"))


_ISO = f"""h AS (SELECT prob AS s, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS w FROM {LINES_SQL} v GROUP BY 1), c AS (SELECT s, sum(y) OVER (ORDER BY s) AS cy, sum(w) OVER (ORDER BY s) AS cw, y, w FROM h),
span AS (SELECT a.s AS a, b.s AS b, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.s <= b.s),
low AS (SELECT h.s, span.a, min(mean) AS m FROM h JOIN span ON span.a <= h.s AND span.b >= h.s GROUP BY ALL), iso AS (SELECT s, max(m) AS value FROM low GROUP BY s)"""


@registry("cal4_isotonic", f"WITH {_ISO} SELECT id, round(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, value)), 6) AS calibrated FROM {LINES_SQL} v JOIN iso ON prob = s")
def cal4(spark, sf):
    df = lines(spark, sf).select("id", "label", "prob")
    return C.apply_isotonic(df, C.isotonic(df, score="prob"), "prob", "calibrated").select("id", F.round("calibrated", 6).alias("calibrated"))


@registry("cal5_calibrators", f"WITH {_PLATT}, {_ISO}, best AS (SELECT b.t AS tt FROM ({_temperature(_points(), _grid(0.05, 10.0, 400))})) SELECT id, round({_sig('(' + _logit('prob') + ' / tt)')}, 6) AS temperature, round({_sig(_PLATT_Z)}, 6) AS platt, round(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, value)), 6) AS isotonic FROM {LINES_SQL} v JOIN iso ON prob = s, fit, best")
def cal5(spark, sf):
    df = lines(spark, sf).select("id", "label", "prob")
    out = df
    for kind in ("temperature", "platt", "isotonic"):
        out = C.fit_calibrator(df, kind, score="prob", out=kind)(out)
    return out.select("id", *(r6(k, k) for k in ("temperature", "platt", "isotonic")))


_SEG = "CASE WHEN qty >= 50 THEN 'rare' ELSE degradation END"


@registry(
    "cal6_segmented",
    f"""WITH v AS (SELECT *, {_SEG} AS seg FROM {LINES_SQL} q), n AS (SELECT seg, count(*) AS n, count(DISTINCT label) AS c FROM v GROUP BY 1),
pts AS (SELECT seg, {_logit('prob')} AS z, label::DOUBLE AS y, count(*) AS k FROM v GROUP BY ALL),
own AS ({_temperature('pts', _grid(0.05, 10.0, 400), 'seg')}), g AS ({_temperature(_points(), _grid(0.05, 10.0, 400))})
SELECT n.seg, n.n, n.n >= 2000 AND c = 2 AS own, round(CASE WHEN n.n >= 2000 AND c = 2 THEN own.b.t ELSE g.b.t END, 6) AS temperature FROM n LEFT JOIN own USING (seg), g""",
)
def cal6(spark, sf):
    df = lines(spark, sf).withColumn("seg", F.expr(_SEG))
    return rounded(C.segmented(df, "seg", 2000, score="prob"), "temperature")


_Z = _logit("prob", "1e-12")
_FIT = f"""fit AS (SELECT avg(z) FILTER (label = 0) AS m0, greatest(stddev_samp(z) FILTER (label = 0), 1e-3) AS s0, avg(z) FILTER (label = 1) AS m1, greatest(stddev_samp(z) FILTER (label = 1), 1e-3) AS s1,
count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM (SELECT label, {_Z} AS z FROM {LINES_SQL} q))"""


@registry("cal7_gaussian_fit", f"WITH {_FIT} SELECT round(m0, 6) AS m0, round(s0, 6) AS s0, round(m1, 6) AS m1, round(s1, 6) AS s1, n0, n1 FROM fit")
def cal7(spark, sf):
    return rounded(C.gaussian_fit(lines(spark, sf), score="prob"), "m0", "s0", "m1", "s1")


# a fixed pair of Gaussians, far enough apart for all three bands
_PAIR = {"m0": -2.0, "s0": 0.7, "m1": 3.0, "s1": 0.5}
_BANDED = f"""p AS (SELECT id, label, {_Z} AS z, -2.0::DOUBLE AS m0, 0.7::DOUBLE AS s0, 3.0::DOUBLE AS m1, 0.5::DOUBLE AS s1 FROM {LINES_SQL} q),
l AS (SELECT *, (-0.5::DOUBLE * ln(2 * pi() * s1 * s1) - 0.5::DOUBLE * ((z - m1) / s1) ** 2) - (-0.5::DOUBLE * ln(2 * pi() * s0 * s0) - 0.5::DOUBLE * ((z - m0) / s0) ** 2) AS llr, abs(z - m0) / s0 AS d0, abs(z - m1) / s1 AS d1 FROM p),
o AS (SELECT *, {_sig('llr')} AS posterior FROM l), bd AS (SELECT *, CASE WHEN least(d0, d1) > 3 THEN 'ABSTAIN' WHEN posterior >= 0.5 THEN 'SYNTHETIC' ELSE 'AUTHENTIC' END AS band FROM o)"""


def opened(spark, sf):
    fit = spark.range(1).select(*(F.lit(v).alias(k) for k, v in _PAIR.items()), F.lit(3).alias("n0"), F.lit(3).alias("n1"))
    return C.open_set(lines(spark, sf), fit, score="prob")


@registry("cal8_llr_posterior_typicality", f"WITH {_BANDED} SELECT id, round(llr, 6) AS llr, round(posterior, 6) AS posterior, round(d0, 6) AS sigmas_from_authentic, round(d1, 6) AS sigmas_from_spoof FROM bd")
def cal8(spark, sf):
    cols = ("llr", "posterior", "sigmas_from_authentic", "sigmas_from_spoof")
    return rounded(opened(spark, sf).select("id", *cols), *cols)


@registry(
    "cal9_decision_boundaries",
    """WITH f AS (SELECT i, CASE i WHEN 0 THEN -2.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS m0, CASE i WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 ELSE 1.0 END::DOUBLE AS s0, CASE i WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 0.0 END::DOUBLE AS m1, CASE i WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS s1 FROM (SELECT unnest(range(3)) AS i)),
k AS (SELECT *, 0.5::DOUBLE / s0**2 - 0.5::DOUBLE / s1**2 AS a, m1 / s1**2 - m0 / s0**2 AS b, 0.5::DOUBLE * m0**2 / s0**2 - 0.5::DOUBLE * m1**2 / s1**2 + ln(s0 / s1) AS c FROM f),
d AS (SELECT *, b * b - 4 * a * c AS d FROM k)
SELECT i::INT AS i, round(CASE WHEN abs(a) < 1e-12 THEN -c / b WHEN d >= 0 THEN least((-b + sqrt(greatest(d, 0))) / (2 * a), (-b - sqrt(greatest(d, 0))) / (2 * a)) END, 6) AS lo, round(CASE WHEN abs(a) >= 1e-12 AND d > 0 THEN greatest((-b + sqrt(greatest(d, 0))) / (2 * a), (-b - sqrt(greatest(d, 0))) / (2 * a)) END, 6) AS hi FROM d""",
)
def cal9(spark, sf):
    cases = [(-2.0, 0.7, 3.0, 0.5), (-1.0, 1.0, 2.0, 1.0), (0.0, 1.0, 0.0, 2.0)]
    out = None
    for i, (m0, s0, m1, s1) in enumerate(cases):
        one = C.boundaries(spark.range(1).select(F.lit(m0).alias("m0"), F.lit(s0).alias("s0"), F.lit(m1).alias("m1"), F.lit(s1).alias("s1")))
        one = one.select(F.lit(i).alias("i"), r6("lo", "lo"), r6("hi", "hi"))
        out = one if out is None else out.unionByName(one)
    return out


@registry("cal10_open_set_bands", f"WITH {_BANDED} SELECT band, label, count(*) AS n FROM bd GROUP BY 1, 2")
def cal10(spark, sf):
    return opened(spark, sf).groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))


@registry("prb5_open_set_read", f"WITH {_BANDED} SELECT round(avg((d1 <= 3)::INT), 6) AS near_spoof, round(avg((least(d0, d1) > 3)::INT), 6) AS outside_both FROM bd")
def prb5(spark, sf):
    d0, d1 = F.col("sigmas_from_authentic"), F.col("sigmas_from_spoof")
    return opened(spark, sf).agg(r6(F.avg((d1 <= 3).cast("int")), "near_spoof"), r6(F.avg((F.least(d0, d1) > 3).cast("int")), "outside_both"))
