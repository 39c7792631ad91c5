"""Evidence fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import DIMENSIONS, verdict
from ..operators import fusion as U
from ..streaming import monitors
from .q_calibration import _grid, _logit, _sig, _temperature
from .registry import Registry, r6, rounded
from .views import EVIDENCE_SQL, evidence

registry = Registry()
HEAD = U.Head({d: w for d, w in zip(DIMENSIONS, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2))}, -0.1, 1.3)
_C = {d: f"(CASE WHEN a_{d} THEN {_logit(f's_{d}')} * {HEAD.weights[d]}::DOUBLE ELSE 0 END)" for d in DIMENSIONS}
_RAW = "(" + " + ".join(_C.values()) + f" + {HEAD.bias}::DOUBLE)"
_P = _sig(f"({_RAW} / {HEAD.temperature}::DOUBLE)")
_VERDICT = "CASE WHEN {p} >= 0.85 THEN 'SYNTHETIC' WHEN {p} >= 0.5 THEN 'SUSPICIOUS' ELSE 'AUTHENTIC' END"


@registry("fus1_evidence_vector", f"SELECT id, {', '.join(f'round(CASE WHEN a_{d} THEN s_{d} ELSE 0.5 END, 6) AS s_{d}, a_{d}' for d in DIMENSIONS)} FROM {EVIDENCE_SQL} v")
def fus1(spark, sf):
    e = evidence(spark, sf)
    scores = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*(F.when(F.col(f"a_{d}"), F.col(f"s_{d}")) for d in DIMENSIONS))), lambda k, v: v.isNotNull())
    flags = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*(F.col(f"a_{d}") for d in DIMENSIONS))), lambda k, v: v)
    out = U.vector(e.select("id", scores.alias("scores"), flags.alias("available")))
    return out.select("id", *(c for d in DIMENSIONS for c in (r6(f"s_{d}", f"s_{d}"), F.col(f"a_{d}"))))


@registry("fus2_verdict", f"SELECT id, {_VERDICT.format(p='s_spectral')} AS verdict FROM {EVIDENCE_SQL} v")
def fus2(spark, sf):
    return evidence(spark, sf).select("id", verdict(F.col("s_spectral")).alias("verdict"))


@registry("fus3_fused_probability", f"SELECT id, round({_RAW}, 6) AS raw, round({_P}, 6) AS p FROM {EVIDENCE_SQL} v")
def fus3(spark, sf):
    return evidence(spark, sf).select("id", r6(U.raw_logit(HEAD), "raw"), r6(U.probability(HEAD), "p"))


@registry("fus4_fit_head")
def fus4(spark, sf):
    head = U.fit(evidence(spark, sf), "id")
    return spark.createDataFrame([(d, w) for d, w in head.weights.items()] + [("bias", head.bias)], "dimension string, weight double")


_PTS = f"(SELECT {_RAW} AS z, label::DOUBLE AS y, count(*) AS k FROM {EVIDENCE_SQL} v GROUP BY ALL)"


@registry("fus5_fit_temperature", f"WITH b AS ({_temperature(_PTS, _grid(0.2, 6.0, 300))}) SELECT round(b.t, 6) AS temperature, round(b.nll, 6) AS nll FROM b")
def fus5(spark, sf):
    return rounded(U.fit_temperature(evidence(spark, sf), HEAD), "temperature", "nll")


_CARDS = " UNION ALL ".join(
    f"SELECT id, {i} AS place, '{d}' AS dimension, {_C[d]} / {HEAD.temperature}::DOUBLE AS c, CASE WHEN a_{d} THEN s_{d} END AS score, CASE WHEN NOT a_{d} THEN '{'STRIPPED' if d == 'exif' else 'PLAUSIBLE'}' ELSE {_VERDICT.format(p=f's_{d}')} END AS verdict FROM {EVIDENCE_SQL} v" for i, d in enumerate(DIMENSIONS)
)


@registry("fus6_scan_cards", f"SELECT id, rank, dimension, round(score, 6) AS score, verdict, round(c, 6) AS contribution FROM (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, place) - 1)::INT AS rank FROM ({_CARDS}))")
def fus6(spark, sf):
    ranked = F.transform("evidence", lambda c, i: F.struct(i.alias("rank"), c["dimension"].alias("dimension"), F.round(c["score"], 6).alias("score"), c["verdict"].alias("verdict"), F.round(c["contribution"], 6).alias("contribution")))
    return U.score_scans(evidence(spark, sf), HEAD).select("id", F.inline(ranked))


@registry("fus7_driver_and_verdict", f"SELECT v.id, {_VERDICT.format(p=_P)} AS verdict, d.dimension AS driver FROM {EVIDENCE_SQL} v JOIN (SELECT id, dimension FROM (SELECT id, dimension, row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, place) AS r FROM ({_CARDS})) WHERE r = 1) d ON v.id = d.id")
def fus7(spark, sf):
    return U.score_scans(evidence(spark, sf), HEAD).select("id", "verdict", "driver")


@registry("fus8_abstention_rate", f"SELECT round(avg(({_P} >= 0.5 AND {_P} < 0.85)::INT), 6) AS abstention_rate FROM {EVIDENCE_SQL} v")
def fus8(spark, sf):
    return rounded(U.abstention_rate(evidence(spark, sf), HEAD), "abstention_rate")


_LIST = "list_filter([" + ", ".join(f"CASE WHEN a_{d} THEN s_{d} END" for d in DIMENSIONS) + "], lambda x: x IS NOT NULL)"


@registry("fus9_disagreement", f"SELECT id, round(CASE WHEN len({_LIST}) > 1 THEN list_stddev_pop({_LIST}) ELSE 0 END, 6) AS disagreement FROM {EVIDENCE_SQL} v")
def fus9(spark, sf):
    return evidence(spark, sf).select("id", r6(U.disagreement(), "disagreement"))


@registry("stream_abstention_monitor", f"SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS scans, round(avg(({_P} >= 0.5 AND {_P} < 0.85)::INT), 6) AS abstention_rate FROM {EVIDENCE_SQL} v GROUP BY 1")
def monitor(spark, sf):
    return rounded(monitors.abstention(evidence(spark, sf), HEAD, window="1 day"), "abstention_rate")


@registry("stream_disagreement_monitor", f"SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS scans, round(avg(CASE WHEN len({_LIST}) > 1 THEN list_stddev_pop({_LIST}) ELSE 0 END), 6) AS disagreement FROM {EVIDENCE_SQL} v GROUP BY 1")
def drift(spark, sf):
    return rounded(monitors.disagreement_drift(evidence(spark, sf), window="1 day"), "disagreement")
