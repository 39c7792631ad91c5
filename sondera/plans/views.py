"""Views of the test tables that the registered queries run on, in expressions both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import DIMENSIONS

LINES = (
    "l_orderkey * 10 + l_linenumber AS id",
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
    "l_extendedprice AS score",
    "l_quantity AS qty",
    "l_quantity / CAST(51 AS DOUBLE) AS prob",
    "CASE WHEN l_returnflag = 'R' THEN concat('gen', CAST(l_linenumber % 5 AS STRING)) ELSE 'authentic' END AS generator",
    "CASE WHEN l_returnflag = 'R' THEN 'synthetic' ELSE 'authentic' END AS family",
    "CASE l_linenumber % 3 WHEN 0 THEN 'q_high' WHEN 1 THEN 'q_mid' ELSE 'q_low' END AS quality",
    "l_linestatus AS degradation",
    "l_shipdate AS ts",
)
MANIFEST = (
    "doc_id",
    "concat(source, '/', CAST(doc_id AS STRING), '.wav') AS path",
    "CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS label",
    "CASE WHEN doc_id % 3 = 0 THEN 'authentic' ELSE concat('gen', CAST(doc_id % 4 AS STRING)) END AS generator",
    "lang AS family",
    "source AS source_id",
    "'audio' AS media_type",
    "'native' AS quality",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*LINES)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(*MANIFEST)


def uniform_spark(x: str) -> str:
    return f"CAST(conv(substring(md5({x}), 1, 8), 16, 10) AS DOUBLE) / CAST(4294967296 AS DOUBLE)"


def uniform_duck(x: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE)"


def _evidence(uniform) -> list[str]:
    key = "CAST(o_orderkey AS STRING)"
    out = ["o_orderkey AS id", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label", "o_orderdate AS ts"]
    for d in DIMENSIONS:
        out.append(f"{uniform(f'''concat('s|{d}|', {key})''')} AS s_{d}")
        out.append(f"{uniform(f'''concat('a|{d}|', {key})''')} >= {'0.35' if d == 'exif' else '0.1'} AS a_{d}")
    return out


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_evidence(uniform_spark))


def sql(columns, source: str) -> str:
    return f"(SELECT {', '.join(columns)} FROM {source})"


LINES_SQL = sql(LINES, "lineitem")
MANIFEST_SQL = sql(MANIFEST, "documents")
EVIDENCE_SQL = sql(_evidence(uniform_duck), "orders")
