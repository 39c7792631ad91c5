"""Metric and harness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harness as H
from ..operators import metrics as M
from .registry import Registry, r6, rounded
from .views import LINES_SQL, lines

registry = Registry()
#: bootstrap resamples, the definition's own number
REPLICATES = 1000


def _cum(source: str = LINES_SQL, score: str = "score", group: str = "") -> str:
    part, sel = (f"PARTITION BY {group}", f"{group},") if group else ("", "")
    return f"""h AS (SELECT {sel} {score} AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {source} v GROUP BY ALL),
c AS (SELECT *, sum(p) OVER ({part} ORDER BY s) AS cp, sum(n) OVER ({part} ORDER BY s) AS cn, sum(p) OVER ({part}) AS tp, sum(n) OVER ({part}) AS tn FROM h)"""


_AUC = "round(sum(p::DOUBLE * (cn - n + n / 2.0::DOUBLE)) / max(tp::DOUBLE * tn), 6)"
_EER = "min({'gap': abs((tn - cn + n)::DOUBLE / tn - (cp - p)::DOUBLE / tp), 'thr': s, 'eer': ((tn - cn + n)::DOUBLE / tn + (cp - p)::DOUBLE / tp) / 2})"


def _thr(f: float) -> str:
    want = f"(tn - greatest(floor({f}::DOUBLE * tn), 1) + 1)"
    return f"max(CASE WHEN cn >= {want} AND cn - n < {want} THEN s END)"


def _strict(f: float) -> str:
    return f"(max(floor({f}::DOUBLE * tn)) < 1)"


def _tpr(f: float, t: str, k: str) -> str:
    return f"sum(CASE WHEN CASE WHEN {k} THEN s > {t} ELSE s >= {t} END THEN p ELSE 0 END)::DOUBLE / max(tp)"


@registry("met1_roc_auc", f"WITH {_cum()} SELECT max(tp)::BIGINT AS n_pos, max(tn)::BIGINT AS n_neg, {_AUC} AS auc FROM c")
def met1(spark, sf):
    return M.ranking(lines(spark, sf), (), ()).select("n_pos", "n_neg", r6("auc", "auc"))


@registry("met1_roc_auc_ties", f"WITH {_cum(score='qty')} SELECT {_AUC} AS auc FROM c")
def met1_ties(spark, sf):
    return M.ranking(lines(spark, sf), (), (), score="qty").select(r6("auc", "auc"))


@registry("met2_threshold_at_fpr", f"WITH {_cum()} SELECT {_thr(0.001)} AS thr_001, {_thr(0.01)} AS thr_01, {_thr(0.05)} AS thr_05 FROM c")
def met2(spark, sf):
    return M.ranking(lines(spark, sf)).select("thr_001", "thr_01", "thr_05")


@registry("met3_tpr_at_fpr", f"WITH {_cum(score='qty')}, t AS (SELECT {_thr(0.05)} AS t, {_strict(0.05)} AS k FROM c) SELECT round({_tpr(0.05, 't.t', 't.k')}, 6) AS tpr FROM c, t")
def met3(spark, sf):
    return M.ranking(lines(spark, sf), (), (0.05,), score="qty").select(r6("tpr_05", "tpr"))


@registry(
    "met4_partial_auc",
    f"""WITH o AS (SELECT label, row_number() OVER (ORDER BY qty DESC, id) AS i FROM {LINES_SQL} v),
r AS (SELECT i, sum(label) OVER (ORDER BY i)::DOUBLE / sum(label) OVER () AS y1, sum(1 - label) OVER (ORDER BY i)::DOUBLE / sum(1 - label) OVER () AS x1 FROM o),
g AS (SELECT x1, y1, coalesce(lag(x1) OVER (ORDER BY i), 0) AS x0, coalesce(lag(y1) OVER (ORDER BY i), 0) AS y0 FROM r),
a AS (SELECT sum(CASE WHEN x1 <= 0.1 THEN (x1 - x0) * (y0 + y1) / 2 WHEN x0 < 0.1 THEN (0.1::DOUBLE - x0) * (2 * y0 + (y1 - y0) * (0.1::DOUBLE - x0) / (x1 - x0)) / 2 ELSE 0 END) AS area FROM g)
SELECT round(0.5 * (1 + (area - 0.005::DOUBLE) / (0.1::DOUBLE - 0.005::DOUBLE)), 6) AS pauc FROM a""",
)
def met4(spark, sf):
    return M.partial_auc(lines(spark, sf), "id", 0.1, score="qty").select(r6("pauc", "pauc"))


@registry("met5_eer", f"WITH {_cum()}, e AS (SELECT {_EER} AS e FROM c) SELECT round(e.eer, 6) AS eer, e.thr AS eer_thr FROM e")
def met5(spark, sf):
    return M.ranking(lines(spark, sf), (), ()).select(r6("eer", "eer"), "eer_thr")


_BIN = " + ".join(f"(prob > {i / 15.0!r}::DOUBLE)::INT" for i in range(1, 15))
_ECE = f"b AS (SELECT {_BIN} AS bin, count(*) AS k, avg(label) AS my, avg(prob) AS mp, sum((prob - label) ** 2) AS sq FROM {LINES_SQL} v GROUP BY 1)"


@registry("met6_ece", f"WITH {_ECE} SELECT round(sum(k * abs(my - mp)) / sum(k), 6) AS ece FROM b")
def met6(spark, sf):
    return M.ece(lines(spark, sf)).select(r6("ece", "ece"))


@registry("met7_brier", f"SELECT round(avg((prob - label) ** 2), 6) AS brier FROM {LINES_SQL} v")
def met7(spark, sf):
    return M.ece(lines(spark, sf)).select(r6("brier", "brier"))


@registry(
    "met8_confusion",
    f"""WITH k AS (SELECT count(*) FILTER (qty >= 25 AND label = 1) AS tp, count(*) FILTER (qty >= 25 AND label = 0) AS fp, count(*) FILTER (qty < 25 AND label = 1) AS fn, count(*) FILTER (qty < 25 AND label = 0) AS tn FROM {LINES_SQL} v)
SELECT tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, round(fp::DOUBLE / (fp + tn), 6) AS fpr, round(fp::DOUBLE / (tp + fp), 6) AS fdr FROM k""",
)
def met8(spark, sf):
    return rounded(M.confusion(lines(spark, sf), 25.0, score="qty"), "precision", "recall", "f1", "fpr", "fdr")


def _mixed(source: str) -> str:
    """source with its 32-bit column x put through the bijection of the draws."""
    for step in ("xor(x, x >> 16)", f"(x * {M._FIRST}) & {M._MASK}", "xor(x, x >> 15)", f"(x * {M._SECOND}) & {M._MASK}", "xor(x, x >> 16)"):
        source = f"(SELECT * REPLACE ({step} AS x) FROM {source})"
    return source


def _resampled(scores: tuple[str, ...], cell: str, replicates: int) -> str:
    """CTEs up to d(rep, scores, y, w): every cell's draw in every replicate."""
    cuts = ", ".join("[" + ", ".join(f"{c}::BIGINT" for c in M.poisson_cuts(k)) + "]" for k in range(1, M.EXACT + 1))
    one = " + ".join(f"(u >= {c})::INT" for c in M.poisson_cuts(1))
    hex8 = lambda i: f"('0x' || substr(md5({cell}), {i}, 8))::BIGINT"
    first = f"(SELECT *, xor(lo, ((rep + 1) * {M._SPREAD}) & {M._MASK}) AS x FROM cells, reps)"
    second = f"(SELECT * REPLACE (xor(x, hi) AS x) FROM {_mixed(first)})"
    third = f"(SELECT *, x AS u FROM {_mixed(second)})"
    last = _mixed(f"(SELECT * REPLACE (xor(x, {M._OTHER}) AS x) FROM {third})")
    z = "sqrt(-2 * ln((u + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) * cos(2 * pi() * ((x + 0.5::DOUBLE) / 4294967296.0::DOUBLE))"
    return f"""cells AS (SELECT label AS y, {', '.join(scores)}, count(*) AS k, {hex8(9)} AS lo, {hex8(1)} AS hi FROM {LINES_SQL} v GROUP BY ALL),
reps AS (SELECT unnest(range({replicates})) AS rep),
d AS (SELECT rep, y, {', '.join(scores)}, CASE WHEN k = 1 THEN {one} WHEN k <= {M.EXACT} THEN len(list_filter([{cuts}][k], lambda c: u >= c)) ELSE greatest(0, floor(k + sqrt(k::DOUBLE) * z + (z * z - 1) / 6 + 0.5::DOUBLE)) END::BIGINT AS w FROM (SELECT *, {z} AS z FROM {last}))"""


def _aucs(score: str, out: str) -> str:
    return f"""{out} AS (SELECT rep, sum(p * (cn - n / 2.0::DOUBLE)) / nullif(sum(p)::DOUBLE * sum(n), 0) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY rep ORDER BY s) AS cn
FROM (SELECT rep, {score} AS s, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM d GROUP BY ALL)) GROUP BY rep)"""


def _interval(value: str, source: str) -> str:
    q = f"quantile_cont({value}, [0.025, 0.5, 0.975])"
    return f"SELECT round(q[1], 6) AS lo, round(q[2], 6) AS mid, round(q[3], 6) AS hi, kept FROM (SELECT {q} AS q, count(*) AS kept FROM {source} WHERE {value} IS NOT NULL)"


def _cell(*parts: str):
    """64 bits of the md5 of a cell's values as whole numbers: both engines write those alike."""
    d = F.md5(F.concat_ws("|", *(F.expr(p).cast("string") for p in parts)))
    half = lambda at: F.conv(F.substring(d, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


_QTY, _BOTH = "concat_ws('|', label, qty::BIGINT)", "concat_ws('|', label, qty::BIGINT, round(score * 100)::BIGINT)"


@registry("met9_bootstrap_ci", f"WITH {_resampled(('qty',), _QTY, REPLICATES)}, {_aucs('qty', 'a')} {_interval('value', 'a')}")
def met9(spark, sf):
    return rounded(M.bootstrap_ci(lines(spark, sf), REPLICATES, scores=("qty",), cell=_cell("y", "cast(qty as bigint)")), "lo", "mid", "hi")


@registry("met10_paired_bootstrap", f"WITH {_resampled(('qty', 'score'), _BOTH, REPLICATES)}, {_aucs('qty', 'a')}, {_aucs('score', 'b')} {_interval('b.value - a.value', 'a JOIN b USING (rep)')}")
def met10(spark, sf):
    return rounded(M.bootstrap_ci(lines(spark, sf), REPLICATES, scores=("qty", "score"), cell=_cell("y", "cast(qty as bigint)", "cast(round(score * 100) as bigint)")), "lo", "mid", "hi")


#: resamples of the callback query: a metric of any kind needs every replicate's histogram
CALLBACK_REPLICATES = 100


@registry(
    "met9_bootstrap_eer",
    f"""WITH {_resampled(('qty',), _QTY, CALLBACK_REPLICATES)}, h AS (SELECT rep, qty AS s, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM d GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY rep ORDER BY s) AS cp, sum(n) OVER (PARTITION BY rep ORDER BY s) AS cn, sum(p) OVER (PARTITION BY rep) AS tp, sum(n) OVER (PARTITION BY rep) AS tn FROM h WHERE p + n > 0),
a AS (SELECT rep, e.eer AS value FROM (SELECT rep, {_EER} AS e FROM c GROUP BY rep)) {_interval('value', 'a')}""",
)
def met9_eer(spark, sf):
    eer = lambda h: M.from_histogram(h, ["rep"]).select("rep", F.col("eer").alias("value"))
    return rounded(M.bootstrap_ci(lines(spark, sf), CALLBACK_REPLICATES, scores=("qty",), fn=eer, cell=_cell("y", "cast(qty as bigint)")), "lo", "mid", "hi")


@registry(
    "met11_summary",
    f"""WITH {_cum()}, {_ECE}, t AS (SELECT {_thr(0.001)} AS a, {_strict(0.001)} AS ak, {_thr(0.01)} AS b, {_strict(0.01)} AS bk, {_thr(0.05)} AS d, {_strict(0.05)} AS dk FROM c),
e AS (SELECT {_EER} AS e FROM c)
SELECT max(tp)::BIGINT AS n_pos, max(tn)::BIGINT AS n_neg, {_AUC} AS auc, round(any_value(e.e.eer), 6) AS eer, any_value(e.e.thr) AS eer_thr,
round({_tpr(0.001, 't.a', 't.ak')}, 6) AS tpr_001, round({_tpr(0.01, 't.b', 't.bk')}, 6) AS tpr_01, round({_tpr(0.05, 't.d', 't.dk')}, 6) AS tpr_05,
(SELECT round(sum(k * abs(my - mp)) / sum(k), 6) FROM b) AS ece, (SELECT round(sum(sq) / sum(k), 6) FROM b) AS brier FROM c, t, e""",
)
def met11(spark, sf):
    df = lines(spark, sf)
    out = M.ranking(df).crossJoin(F.broadcast(M.ece(df)))
    return out.select("n_pos", "n_neg", r6("auc", "auc"), r6("eer", "eer"), "eer_thr", *(r6(c, c) for c in ("tpr_001", "tpr_01", "tpr_05", "ece", "brier")))


@registry("met12_input_contract", f"SELECT count(*) AS rows, count(*) FILTER (isnan(score)) AS nan_scores FROM {LINES_SQL} v")
def met12(spark, sf):
    return M.checked(lines(spark, sf)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.isnan("score")).alias("nan_scores"))


_ODD = "SELECT CASE WHEN qty > 45 THEN 'NaN'::DOUBLE WHEN qty < 4 THEN NULL ELSE score END AS score, CASE WHEN quality = 'q_low' THEN NULL ELSE label + (qty > 40)::INT END AS label FROM " + LINES_SQL + " v"


@registry("met12_odd_inputs", f"SELECT count(*) AS rows, count(*) FILTER (isnan(score)) AS nan_scores, count(*) FILTER (score IS NULL) AS null_scores, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS other_labels FROM ({_ODD})")
def met12_odd(spark, sf):
    odd = lines(spark, sf).selectExpr("CASE WHEN qty > 45 THEN double('NaN') WHEN qty < 4 THEN NULL ELSE score END AS score", "CASE WHEN quality = 'q_low' THEN NULL ELSE label + int(qty > 40) END AS label")
    return M.input_contract(odd)


@registry("met2_strict_threshold", f"WITH {_cum(score='qty')}, t AS (SELECT tn - floor(0.05::DOUBLE * tn) AS w, * FROM c) SELECT max(CASE WHEN cn >= w + 1 AND cn - n < w + 1 THEN s END) AS thr, round(sum(CASE WHEN cn - n >= w THEN p ELSE 0 END)::DOUBLE / max(tp), 6) AS tpr FROM t")
def met2_strict(spark, sf):
    out = M.ranking(lines(spark, sf), (), (0.05,), score="qty", strict=True)
    return out.select(F.col("thr_05").alias("thr"), r6("tpr_05", "tpr"))


@registry(
    "agg5_model_by_degradation",
    f"""WITH u AS (SELECT 'price' AS model, degradation, label, score AS x FROM {LINES_SQL} v UNION ALL SELECT 'quantity', degradation, label, qty FROM {LINES_SQL} v),
h AS (SELECT model, degradation, x AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM u GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model, degradation) AS tp, sum(n) OVER (PARTITION BY model, degradation) AS tn FROM h WINDOW w AS (PARTITION BY model, degradation ORDER BY s)),
g AS (SELECT model, degradation, max(tp) AS tp, max(tn) AS tn, sum(p::DOUBLE * (cn - n + n / 2.0::DOUBLE)) / nullif(max(tp::DOUBLE * tn), 0) AS auc, min(CASE WHEN tp * tn > 0 THEN {{'gap': abs((tn - cn + n)::DOUBLE / nullif(tn, 0) - (cp - p)::DOUBLE / nullif(tp, 0)), 'thr': s, 'eer': ((tn - cn + n)::DOUBLE / nullif(tn, 0) + (cp - p)::DOUBLE / nullif(tp, 0)) / 2}} END) AS e FROM c GROUP BY model, degradation)
SELECT model, degradation, round(auc, 6) AS auc, round(e.eer, 6) AS eer FROM g""",
)
def agg5(spark, sf):
    out = M.levels(lines(spark, sf), {"degradation": "degradation"}, {"price": "score", "quantity": "qty"})
    return out.select("model", F.col("key").alias("degradation"), r6("auc", "auc"), r6("eer", "eer"))


def _har1(source: str = LINES_SQL, score: str = "score", x: str = "") -> str:
    return f"""{x}neg AS (SELECT {score} AS s, row_number() OVER (ORDER BY {score}) AS i, count(*) OVER () AS tn FROM {source} v WHERE label = 0),
{x}t AS (SELECT max(CASE WHEN i = tn - greatest(floor(0.01::DOUBLE * tn), 1)::BIGINT + 1 THEN s END) AS t, max(floor(0.01::DOUBLE * tn)) < 1 AS k FROM {x}neg),
{x}hn AS (SELECT s, count(*) AS n FROM {x}neg GROUP BY s), {x}hp AS (SELECT generator AS key, {score} AS s, count(*) AS p FROM {source} v WHERE label = 1 GROUP BY ALL),
{x}al AS (SELECT s, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY s) AS cn FROM (SELECT DISTINCT s FROM {x}hp UNION SELECT s FROM {x}hn) LEFT JOIN {x}hn USING (s)),
{x}g AS (SELECT key, sum(p) AS n, sum(CASE WHEN CASE WHEN t.k THEN s > t.t ELSE s >= t.t END THEN p ELSE 0 END)::DOUBLE / sum(p) AS tpr, sum(p * (cn - al.n + al.n / 2.0::DOUBLE)) / (sum(p) * (SELECT count(*) FROM {x}neg)::DOUBLE) AS auc FROM {x}hp JOIN {x}al al USING (s), {x}t t GROUP BY key)"""


@registry("har1_group_metrics", f"WITH {_har1()} SELECT key, n::BIGINT AS n, round(auc, 6) AS auc, round(tpr, 6) AS tpr_01, n < 30 AS low_n FROM g")
def har1(spark, sf):
    return H.group_metrics(lines(spark, sf), "generator").select("key", "n", r6("auc", "auc"), r6("tpr_01", "tpr_01"), "low_n")


@registry("har6_flags", f"WITH {_har1(score='qty')} SELECT key, CASE WHEN n < 30 THEN 'low n' WHEN auc < 0.6 THEN 'BLIND' WHEN auc < 0.8 THEN 'weak' ELSE '' END AS flag FROM g")
def har6(spark, sf):
    return H.flagged(H.group_metrics(lines(spark, sf).withColumn("score", F.col("qty")), "generator")).select("key", "flag")


def _by(group: str) -> str:
    return f"""WITH {_cum(group=group)}, t AS (SELECT {group}, {_thr(0.01)} AS t, {_strict(0.01)} AS k FROM c GROUP BY {group})
SELECT {group}, (max(tp) + max(tn))::BIGINT AS n, {_AUC} AS auc, round({_tpr(0.01, 't.t', 't.k')}, 6) AS tpr FROM c JOIN t USING ({group}) GROUP BY {group} HAVING max(tp) > 0 AND max(tn) > 0"""


@registry("har2_robustness", _by("degradation").replace("sum(p::DOUBLE * (cn - n + n / 2.0::DOUBLE)) / max(tp::DOUBLE * tn)", "sum(p::DOUBLE * (cn - n + n / 2.0::DOUBLE)) / nullif(max(tp::DOUBLE * tn), 0)").replace("::DOUBLE / max(tp)", "::DOUBLE / nullif(max(tp), 0)"))
def har2(spark, sf):
    return rounded(H.robustness(lines(spark, sf)), "auc", "tpr")


@registry("har2_per_quality", f"WITH {_cum(group='quality')} SELECT quality, (max(tp) + max(tn))::BIGINT AS n, {_AUC} AS auc FROM c GROUP BY quality")
def har2q(spark, sf):
    return rounded(H.per_quality(lines(spark, sf)), "auc")


@registry(
    "har5_release_gate",
    f"""WITH {_har1(score="qty", x="i_")},
{_har1()}, f AS (SELECT list(g.key ORDER BY g.key) AS keys FROM g JOIN i_g ig USING (key) WHERE g.n >= 30 AND ig.tpr - g.tpr > 0.03),
o AS (SELECT sum(g.tpr * g.n) / sum(g.n) AS ct, (SELECT sum(tpr * n) / sum(n) FROM i_g) AS it FROM g)
SELECT (ct < it - 1e-9 OR coalesce(len(keys), 0) > 0) AS blocked, concat_ws(',', CASE WHEN ct < it - 1e-9 THEN 'overall' END, nullif(array_to_string(coalesce(keys, []), ','), '')) AS reasons FROM f, o""",
)
def har5(spark, sf):
    return H.gate(H.measure(lines(spark, sf), levels=("overall", "generator"), scores={"candidate": "score", "incumbent": "qty"}))


_GROUPED = {"overall": "'all'", "generator": "generator", "family": "family", "quality": "CASE WHEN qty > 40 THEN NULL ELSE quality END", "degradation": "degradation"}
_UNION = " UNION ALL ".join(f"SELECT '{v}' AS level, coalesce({k}, 'nan') AS key, label, qty AS s, prob FROM {LINES_SQL} v" for v, k in _GROUPED.items())
_WANT = {f: f"(tn - greatest(floor({f}::DOUBLE * tn), 1) + 1)" for f in (0.001, 0.01, 0.05)}


def _rates(f: float) -> str:
    k, w = M.name(f), _WANT[f]
    return f"""max(CASE WHEN cn >= {w} AND cn - ns < {w} AND ns > 0 THEN s END) AS thr_{k}, max(floor({f}::DOUBLE * tn)) < 1 AS strict_{k},
round(sum(CASE WHEN cn - ns >= {w} OR (cn >= {w} AND floor({f}::DOUBLE * tn) >= 1) THEN p ELSE 0 END)::DOUBLE / nullif(sum(p), 0), 6) AS tpr_{k}"""


@registry(
    "har_evaluate",
    f"""WITH {_resampled(('qty',), _QTY, 500)}, {_aucs('qty', 'boot')}, u AS ({_UNION}),
h AS (SELECT level, key, CASE WHEN level IN ('generator', 'family') THEN '' ELSE key END AS peer, s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM u GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, peer ORDER BY s) AS cn, sum(n) OVER (PARTITION BY level, peer, s) AS ns, sum(p) OVER (PARTITION BY level, peer ORDER BY s) AS cp, sum(n) OVER (PARTITION BY level, peer) AS tn, sum(p) OVER (PARTITION BY level, peer) AS tp FROM h),
g AS (SELECT level, key, sum(p)::BIGINT AS n_pos, max(tn)::BIGINT AS n_neg, round(sum(p * (cn - ns / 2.0::DOUBLE)) / nullif(sum(p)::DOUBLE * max(tn), 0), 6) AS auc,
min(CASE WHEN tp * tn > 0 THEN {{'gap': abs((tn - cn + ns)::DOUBLE / nullif(tn, 0) - (cp - p)::DOUBLE / nullif(tp, 0)), 'thr': s, 'eer': ((tn - cn + ns)::DOUBLE / nullif(tn, 0) + (cp - p)::DOUBLE / nullif(tp, 0)) / 2}} END) AS e, {', '.join(map(_rates, _WANT))} FROM c GROUP BY level, key),
b AS (SELECT level, key, {_BIN} AS bin, count(*) AS k, avg(label) AS my, avg(prob) AS mp, sum((prob - label) ** 2) AS sq FROM u WHERE level IN ('overall', 'quality') GROUP BY ALL),
p AS (SELECT level, key, round(sum(k * abs(my - mp)) / sum(k), 6) AS ece, round(sum(sq) / sum(k), 6) AS brier FROM b GROUP BY ALL),
i AS ({_interval('value', 'boot')})
SELECT level, key, n_pos, n_neg, auc, CASE WHEN level IN ('generator', 'family') THEN NULL ELSE round(e.eer, 6) END AS eer, CASE WHEN level IN ('generator', 'family') THEN NULL ELSE e.thr END AS eer_thr,
{', '.join(f'{w}_{M.name(f)}' for f in _WANT for w in ('thr', 'strict', 'tpr'))}, CASE WHEN level IN ('generator', 'family') THEN n_pos ELSE n_pos + n_neg END AS n,
CASE WHEN level IN ('generator', 'family') THEN n_pos ELSE n_pos + n_neg END < 30 AS low_n, CASE WHEN level = 'overall' THEN i.lo END AS auc_lo, CASE WHEN level = 'overall' THEN i.hi END AS auc_hi, ece, brier
FROM g CROSS JOIN i LEFT JOIN p USING (level, key) WHERE n_pos > 0 AND (n_neg > 0 OR level IN ('overall', 'generator', 'family'))""",
)
def har_evaluate(spark, sf):
    df = lines(spark, sf).withColumn("quality", F.when(F.col("qty") <= 40, F.col("quality"))).withColumn("score", F.col("qty"))
    cell = _cell("y", "cast(score as bigint)")
    out = H.evaluate_table(df.select("label", "score", "prob", "generator", "family", "quality", "degradation"), prob="prob", cell=cell)
    kept = [c for c in out.columns if c.startswith("tpr_")]
    return rounded(out, "auc", "eer", "auc_lo", "auc_hi", "ece", "brier", *kept)
