"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain > language > source; every node has a weight, and a node's target is its share of
its parent's budget by weight. A node can take no more than its capacity: the tokens of its leaves
times the epochs allowed. At each node the budget is poured over the children by weight until they
are full (water filling), so what a child can't take goes to its siblings, and only when all of them
are full does the shortage reach the parent's siblings: a parent's capacity is that of its children.

Each leaf then takes a prefix of its tokens: whole epochs first, then, in an order seeded by epoch,
the texts whose start lies before what is left. The order's running sums are taken in two steps,
over 4096 ranges of the hash and within the range that holds the end, so that a leaf with a third of
all rows is not ordered in one task.

DataFrame operations only; the node tables are as small as the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read

SEED, MAX_EPOCHS, BUDGET_SHARE = 7, 4, 0.5
#: Weights by domain and by language; anything that is not named weighs 1, and so does every source.
DOMAIN_WEIGHTS = {"d0": 3.0, "d1": 1.0, "d2": 1.0}
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}


def n_words(text: Column) -> Column:
    """Tokens of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(0)), F.lit(3)))


def weight_of(column: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(column == k, F.lit(float(v))).otherwise(out)
    return out


def pour(nodes: DataFrame, parent: list[str], budget: str = "budget") -> DataFrame:
    """Water filling: nodes (weight, cap, and their parent's budget) with `alloc` added. Children of
    least capacity for their weight fill first; the rest share what is left by weight."""
    fill = F.col("cap") / F.col("weight")
    order = W.partitionBy(*parent).orderBy(fill, "cap", "node")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*parent)
    left = F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = left / weight_left
    # a child is full if the level that it and those after it would reach is at its brim or above
    nodes = nodes.withColumn("full", level >= fill).withColumn("level", level)
    first = F.min(F.when(~F.col("full"), F.struct(fill.alias("f"), F.col("cap").alias("c"), F.col("node").alias("n"), F.col("level").alias("level")))).over(every)
    out = nodes.withColumn("rest", first["level"])
    return out.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.lit(0.0), F.col("rest") * F.col("weight")))).drop("full", "level", "rest")


def budgets(leaves: DataFrame, budget_share: float, max_epochs: int, domain_weights: dict, lang_weights: dict) -> DataFrame:
    """domain, lang, source, tokens, alloc for leaves (domain, lang, source, tokens)."""
    leaves = leaves.where("tokens > 0").withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg((F.sum("tokens") * budget_share).cast("double").alias("budget"))
    top = domains.withColumn("node", F.col("domain")).withColumn("weight", weight_of(F.col("domain"), domain_weights)).withColumn("root", F.lit(0)).crossJoin(F.broadcast(total))
    top = pour(top, ["root"]).select("domain", F.col("alloc").alias("budget"))
    mid = langs.withColumn("node", F.col("lang")).withColumn("weight", weight_of(F.col("lang"), lang_weights)).join(top, "domain")
    mid = pour(mid, ["domain"]).select("domain", "lang", F.col("alloc").alias("budget"))
    low = leaves.withColumn("node", F.col("source")).withColumn("weight", F.lit(1.0)).join(mid, ["domain", "lang"])
    return pour(low, ["domain", "lang"]).select("domain", "lang", "source", "tokens", "alloc")


def mix(docs: DataFrame, id_col: str = "doc_id", budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain_weights: dict = DOMAIN_WEIGHTS, lang_weights: dict = LANG_WEIGHTS) -> DataFrame:
    """id, domain, lang, source, epoch, n_tokens: a row for each time that a text is taken.

    The budget is `budget_share` of all tokens (over 1 to repeat). Null languages and sources are
    leaves of their own, named ''. Texts without words (null texts too) have no tokens and are never
    taken. Repeated rows are taken each by itself, in the order of the hash, then id, then tokens; a
    null id comes first. An empty table gives an empty result. Extra columns are left out.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        domain_of(F.coalesce("source", F.lit(""))).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        n_words(F.col("text")).alias("n_tokens"),
    ).where("n_tokens > 0")
    rows, _ = materialize(rows, "mixing-rows")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, budget_share, max_epochs, domain_weights, lang_weights)
    plan = plan.withColumn("whole", F.least(F.lit(max_epochs), F.floor(F.col("alloc") / F.col("tokens")).cast("int")))
    plan, _ = materialize(plan.withColumn("left", F.greatest(F.lit(0.0), F.col("alloc") - F.col("whole") * F.col("tokens"))).drop("tokens", "alloc"), "mixing-plan")
    taken = rows.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, leaf)
    full = taken.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    part = taken.where("left > 0").withColumn("epoch", F.col("whole"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    part = part.withColumn("hash", digest).withColumn("range", F.substring("hash", 1, 3))
    ranges = part.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("in_range"))
    ahead = F.coalesce(F.sum("in_range").over(W.partitionBy(*leaf).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("ahead", ahead)
    part = part.join(ranges, [*leaf, "range"]).where(F.col("ahead") < F.col("left"))
    inside = W.partitionBy(*leaf, "range").orderBy("hash", "id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    settled = part.where(F.col("ahead") + F.col("in_range") <= F.col("left"))
    cut = part.where(F.col("ahead") + F.col("in_range") > F.col("left")).withColumn("start", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where(F.col("start") < F.col("left"))
    columns = [F.col("id").alias(id_col), *leaf, F.col("epoch").cast("int").alias("epoch"), "n_tokens"]
    return full.select(*columns).unionByName(settled.select(*columns)).unionByName(cut.select(*columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _cases(column: str, weights: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " ELSE 1.0::DOUBLE END"


def _pour_sql(source: str, parent: str, keep: str) -> str:
    """DuckDB: the same allocation found by searching the water level among the children's brims."""
    return f"""
      SELECT {keep}, CASE WHEN cap / weight <= lvl THEN cap ELSE greatest(0, lvl * weight) END AS alloc FROM (
        SELECT n.*, (
          SELECT CASE WHEN sum(m.cap) <= n.budget THEN 1e300 ELSE (
            SELECT arg_min((n.budget - full_cap) / open_weight, s.brim) FROM (
              SELECT b.brim,
                (SELECT coalesce(sum(x.cap), 0) FROM {source} x WHERE {parent} AND x.cap / x.weight < b.brim) AS full_cap,
                (SELECT coalesce(sum(x.weight), 0) FROM {source} x WHERE {parent} AND x.cap / x.weight >= b.brim) AS open_weight
              FROM (SELECT DISTINCT x.cap / x.weight AS brim FROM {source} x WHERE {parent}) b
            ) s WHERE open_weight > 0 AND (n.budget - full_cap) / open_weight <= s.brim
          ) END FROM {source} m WHERE {parent.replace('x.', 'm.')}
        ) AS lvl FROM {source} n)"""


ORACLE_SQL = f"""
WITH rows AS (
  SELECT doc_id, 'd' || (coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '(\\d{{1,9}})$', 1) AS INT), 0) % 3) AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents WHERE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, (sum(n_tokens) * {MAX_EPOCHS})::DOUBLE AS cap FROM rows GROUP BY ALL),
doms AS (SELECT domain, sum(cap) AS cap, {_cases("domain", DOMAIN_WEIGHTS)} AS weight, (SELECT sum(tokens) * {BUDGET_SHARE} FROM leaves) AS budget FROM leaves GROUP BY domain),
doms2 AS ({_pour_sql("doms", "true", "domain")}),
lngs AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, {_cases("l.lang", LANG_WEIGHTS)} AS weight, any_value(d.alloc) AS budget FROM leaves l JOIN doms2 d USING (domain) GROUP BY l.domain, l.lang),
lngs2 AS ({_pour_sql("lngs", "x.domain = n.domain", "domain, lang")}),
lvs AS (SELECT l.*, 1.0::DOUBLE AS weight, g.alloc AS budget FROM leaves l JOIN lngs2 g USING (domain, lang)),
lvs2 AS ({_pour_sql("lvs", "x.domain = n.domain AND x.lang = n.lang", "domain, lang, source, tokens")}),
epochs AS (SELECT r.*, e.epoch, v.alloc - e.epoch * v.tokens AS room FROM rows r JOIN lvs2 v USING (domain, lang, source), (SELECT unnest(range({MAX_EPOCHS})) AS epoch) e WHERE v.alloc - e.epoch * v.tokens > 0),
ordered AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}|' || epoch || '|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM epochs)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, n_tokens FROM ordered WHERE start < room
"""
