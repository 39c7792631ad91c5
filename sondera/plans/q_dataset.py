"""Relational verbs, dataset construction, near-duplicates, sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lsh, order, replay, split
from ..sources import io, scratch
from .registry import Registry, r6
from .views import LINES_SQL, MANIFEST_SQL, lines, manifest, table, uniform_duck

registry = Registry()
SPEC = split.SplitSpec(("gen1",), 0.25, 0.2, 0)
_FRAC = uniform_duck("source_id")
SPLIT_SQL = f"""(WITH m AS (SELECT *, (generator = 'gen1' OR (generator = 'authentic' AND {_FRAC} < 0.2)) AS test FROM {MANIFEST_SQL} v),
vals AS (SELECT source_id FROM (SELECT DISTINCT source_id FROM m WHERE NOT test) ORDER BY md5('0|' || source_id), source_id LIMIT (SELECT greatest(1, floor(count(DISTINCT source_id) * 0.25::DOUBLE))::BIGINT FROM m WHERE NOT test))
SELECT m.* EXCLUDE (test), CASE WHEN test THEN 'test' WHEN source_id IN (SELECT source_id FROM vals) THEN 'val' ELSE 'train' END AS split FROM m)"""


def divided(spark, sf):
    return split.group_split(manifest(spark, sf), SPEC)


@registry("rel1_validate_manifest", f"""WITH k AS (SELECT path, count(*) AS k, count(*) FILTER (label NOT IN (0, 1) OR label IS NULL) AS bad, count(*) FILTER (generator = 'authentic' AND label <> 0) AS wrong FROM {MANIFEST_SQL} v GROUP BY path)
SELECT sum(bad)::BIGINT AS bad_labels, sum(k - 1)::BIGINT AS duplicate_paths, sum(wrong)::BIGINT AS authentic_positives, sum(k)::BIGINT AS rows FROM k""")
def rel1(spark, sf):
    return split.manifest_problems(manifest(spark, sf))


@registry("rel2_equality_filter", f"SELECT degradation, count(*) AS n FROM {LINES_SQL} v WHERE degradation = 'F' AND label = 1 GROUP BY 1")
def rel2(spark, sf):
    return lines(spark, sf).where("degradation = 'F' and label = 1").groupBy("degradation").agg(F.count(F.lit(1)).alias("n"))


@registry("rel3_isin_semi_join", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def rel3(spark, sf):
    keys = table(spark, sf, "nation").where(F.col("n_regionkey").isin(1, 3)).select("n_nationkey")
    c = table(spark, sf, "customer")
    return c.join(keys, c["c_nationkey"] == keys["n_nationkey"], "left_semi").select("c_custkey")


@registry("rel4_computed_columns", f"SELECT id, CASE WHEN label = 1 THEN 'fake' ELSE 'real' END AS kind, 'unknown' AS channel FROM {LINES_SQL} v")
def rel4(spark, sf):
    return lines(spark, sf).select("id", F.when(F.col("label") == 1, "fake").otherwise("real").alias("kind"), F.lit("unknown").alias("channel"))


@registry("rel5_path_normalise", f"SELECT doc_id, path FROM {MANIFEST_SQL} v")
def rel5(spark, sf):
    windows = manifest(spark, sf).withColumn("path", F.translate("path", "/", "\\"))
    return windows.select("doc_id", S.normalise_path(F.col("path")).alias("path"))


@registry("rel6_prefix_rewrite", f"SELECT doc_id, replace(path, 'src', 'degraded/src') AS path FROM {MANIFEST_SQL} v")
def rel6(spark, sf):
    return manifest(spark, sf).select("doc_id", F.replace("path", F.lit("src"), F.lit("degraded/src")).alias("path"))


def _family_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({col}), '{k}') THEN '{v}'" for k, v in S.FAMILIES.items()) + " ELSE 'unknown' END"


@registry("rel7_family_lookup", f"SELECT doc_id, {_family_sql('g')} AS family FROM (SELECT doc_id, list_element(['StyleGAN2', 'sdxl-turbo', 'Piper', 'authentic', 'mystery'], (doc_id % 5 + 1)::INT) AS g FROM documents)")
def rel7(spark, sf):
    names = F.array(*map(F.lit, ("StyleGAN2", "sdxl-turbo", "Piper", "authentic", "mystery")))
    return table(spark, sf, "documents").select("doc_id", S.family_of(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int"))).alias("family"))


@registry("rel8_sort_by_path", f"SELECT path, label FROM {MANIFEST_SQL} v ORDER BY path")
def rel8(spark, sf):
    return manifest(spark, sf).select("path", "label").orderBy("path")


@registry("rel9_union_degraded", f"SELECT path, 'none' AS degradation FROM {MANIFEST_SQL} v UNION ALL SELECT replace(path, '.wav', '_tel.wav'), 'telephone' FROM {MANIFEST_SQL} v")
def rel9(spark, sf):
    m = manifest(spark, sf).select("path")
    return m.withColumn("degradation", F.lit("none")).unionByName(m.select(F.replace("path", F.lit(".wav"), F.lit("_tel.wav")).alias("path"), F.lit("telephone").alias("degradation")))


@registry("rel10_quota", """WITH ok AS (SELECT * FROM events WHERE value BETWEEN 2 AND 120), f AS (SELECT user_id, min(event_id) AS f FROM ok GROUP BY 1 ORDER BY f, user_id LIMIT 20)
SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM ok JOIN f USING (user_id)) WHERE r <= 5""")
def rel10(spark, sf):
    return split.quota(table(spark, sf, "events"), "user_id", "event_id", 20, 5, F.col("value").between(2, 120)).select("event_id", "user_id")


@registry("rel11_round_robin", """SELECT s_suppkey, list_element(['anna', 'ben', 'cleo'], ((row_number() OVER (ORDER BY s_suppkey) - 1) % 3 + 1)::INT) AS voice, unnest(['a', 'b']) AS engine FROM supplier""")
def rel11(spark, sf):
    return replay.round_robin(table(spark, sf, "supplier"), "s_suppkey", ["anna", "ben", "cleo"], ["a", "b"])


@registry("rel12_key_lookup_join", "SELECT l_orderkey, l_linenumber, round(p_retailprice, 2) AS price FROM lineitem JOIN part ON l_partkey = p_partkey")
def rel12(spark, sf):
    met = split.lookup(table(spark, sf, "lineitem"), table(spark, sf, "part"), {"l_partkey": "p_partkey"})
    return met.select("l_orderkey", "l_linenumber", F.round("p_retailprice", 2).alias("price"))


@registry("rel13_index_lookup", "SELECT vec_id, label FROM embeddings WHERE label = 6")
def rel13(spark, sf):
    return table(spark, sf, "embeddings").where("label = 6").select("vec_id", "label")


@registry("rel14_best_row", f"""WITH g AS (SELECT qty::INT AS layer, round(avg(label), 6) AS test_auc, round(abs(avg(label) - 0.25::DOUBLE), 6) AS gap FROM {LINES_SQL} v GROUP BY 1)
SELECT arg_max(layer, test_auc * 1000 - layer / 1000000.0::DOUBLE) AS best_layer, arg_min(layer, gap * 1000 + layer / 1000000.0::DOUBLE) AS stable_layer FROM g""")
def rel14(spark, sf):
    g = lines(spark, sf).groupBy(F.col("qty").cast("int").alias("layer")).agg(F.round(F.avg("label"), 6).alias("test_auc"), F.round(F.abs(F.avg("label") - 0.25), 6).alias("gap"))
    return g.agg(F.max_by("layer", F.struct("test_auc", -F.col("layer"))).alias("best_layer"), F.min_by("layer", F.struct("gap", "layer")).alias("stable_layer"))


@registry("rel15_split_intersection", f"SELECT source_id FROM {SPLIT_SQL} v WHERE split = 'train' INTERSECT SELECT source_id FROM {SPLIT_SQL} v WHERE split = 'test'")
def rel15(spark, sf):
    d = divided(spark, sf)
    return d.where("split = 'train'").select("source_id").intersect(d.where("split = 'test'").select("source_id"))


@registry("rel16_completeness", "SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def rel16(spark, sf):
    return io.missing_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@registry("rel17_unpivot", f"SELECT id, 'score' AS model, score AS x FROM {LINES_SQL} v UNION ALL SELECT id, 'qty', qty FROM {LINES_SQL} v")
def rel17(spark, sf):
    return lines(spark, sf).unpivot("id", ["score", "qty"], "model", "x")


_T18 = "trim(c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '?' ELSE '' END)"


@registry("rel18_normalise_text", f"SELECT c_custkey, CASE WHEN regexp_matches(t, '[.?!]$') THEN t ELSE t || '.' END AS text FROM (SELECT c_custkey, upper(substr({_T18}, 1, 1)) || lower(substr({_T18}, 2)) AS t FROM customer)")
def rel18(spark, sf):
    raw = F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "?").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", S.normalise_text(raw).alias("text"))


@registry("rel19_number_format", f"SELECT generator, printf('%.3f', avg(qty)) AS mean FROM {LINES_SQL} v GROUP BY 1")
def rel19(spark, sf):
    return lines(spark, sf).groupBy("generator").agg(F.format_string("%.3f", F.avg("qty")).alias("mean"))


@registry("rel20_incremental_skip", "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id = e.event_id AND d.event_type = 'click')")
def rel20(spark, sf):
    e = table(spark, sf, "events")
    return e.join(e.where("event_type = 'click'").select("event_id"), "event_id", "left_anti").select("event_id")


@registry("agg1_balance", f"SELECT split, family, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1 FROM {SPLIT_SQL} v GROUP BY 1, 2")
def agg1(spark, sf):
    return split.balance(divided(spark, sf))


@registry("agg2_group_sizes", f"SELECT degradation, label, count(*) AS n FROM {LINES_SQL} v GROUP BY 1, 2")
def agg2(spark, sf):
    return lines(spark, sf).groupBy("degradation", "label").agg(F.count(F.lit(1)).alias("n"))


@registry("agg3_scenario_summary", f"""WITH b AS (SELECT degradation, generator, qty, CASE WHEN qty < 17 THEN 'AUTHENTIC' WHEN qty < 34 THEN 'ABSTAIN' ELSE 'SYNTHETIC' END AS band FROM {LINES_SQL} v),
k AS (SELECT degradation, generator, string_agg(band || ':' || n, ' ' ORDER BY band) AS bands FROM (SELECT degradation, generator, band, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL)
SELECT b.degradation, b.generator, count(*) AS n, quantile_cont(qty, 0.5) AS med, min(qty) AS lo, max(qty) AS hi, any_value(bands) AS bands FROM b JOIN k ON b.degradation = k.degradation AND b.generator = k.generator GROUP BY ALL""")
def agg3(spark, sf):
    band = F.when(F.col("qty") < 17, "AUTHENTIC").when(F.col("qty") < 34, "ABSTAIN").otherwise("SYNTHETIC")
    b = lines(spark, sf).withColumn("band", band)
    key = ["degradation", "generator"]
    text = b.groupBy(*key, "band").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "band", "n"))), " ").alias("bands"))
    return order.quantiles(b, key, "qty", {"med": 0.5}).select(*key, "n", "med", "lo", "hi").join(text, key)


@registry("agg4_class_coverage", f"SELECT split, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1, count(*) FILTER (label = 0) = 0 OR count(*) FILTER (label = 1) = 0 AS single_class FROM {SPLIT_SQL} v GROUP BY 1")
def agg4(spark, sf):
    return split.coverage(divided(spark, sf))


@registry("dat1_hash_fraction", f"SELECT DISTINCT source_id, round({_FRAC}, 6) AS fraction FROM {MANIFEST_SQL} v")
def dat1(spark, sf):
    return manifest(spark, sf).select("source_id", r6(split.hash_fraction(F.col("source_id")), "fraction")).distinct()


@registry("dat1_blake_fraction")
def dat1b(spark, sf):
    return manifest(spark, sf).select("source_id").distinct().select("source_id", split.blake_fraction(F.col("source_id")).alias("fraction"))


@registry("dat2_group_split", f"SELECT doc_id, split FROM {SPLIT_SQL} v")
def dat2(spark, sf):
    return divided(spark, sf).select("doc_id", "split")


def _leak(a: str, b: str) -> str:
    g = f"(SELECT coalesce(string_agg(generator, ',' ORDER BY generator), '') FROM (SELECT DISTINCT generator FROM s WHERE label = 1 AND split = '{a}' INTERSECT SELECT DISTINCT generator FROM s WHERE label = 1 AND split = '{b}'))"
    n = f"(SELECT count(*) FROM (SELECT DISTINCT source_id FROM s WHERE split = '{a}' INTERSECT SELECT DISTINCT source_id FROM s WHERE split = '{b}'))"
    return f"SELECT '{a}|{b}' AS pair, {n} AS shared_sources, {g} AS shared_generators, {n} > 0 OR ({(a, b) == ('train', 'test')} AND {g} <> '') AS problem"


@registry("dat3_leakage", f"WITH s AS (SELECT * FROM {SPLIT_SQL} v) {_leak('train', 'val')} UNION ALL {_leak('train', 'test')} UNION ALL {_leak('val', 'test')}")
def dat3(spark, sf):
    return split.leakage(divided(spark, sf))


_HASH = "list_reduce([CASE WHEN embedding[i + 1] > 0 THEN (CASE WHEN i = 63 THEN -9223372036854775808 ELSE 1::BIGINT << i END)::BIGINT ELSE 0::BIGINT END for i in range(64)], lambda x, y: (x | y)::BIGINT)"


def hashes(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), lsh.sign_hash().alias("hash"))


@registry("dat5_hamming", f"WITH h AS (SELECT vec_id AS id, {_HASH} AS hash FROM embeddings) SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM h a JOIN h b ON b.id = a.id + 1")
def dat5(spark, sf):
    h = hashes(spark, sf)
    a, b = h.alias("a"), h.alias("b")
    return a.join(b, F.col("b.id") == F.col("a.id") + 1).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), S.hamming64(F.col("a.hash"), F.col("b.hash")).alias("distance"))


def reencoded_hashes(spark, sf):
    """The hashes and, of each, a second one under its id + 1,000,000 with up to eight bits flipped."""
    h = hashes(spark, sf)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("id") * (2 * k + 3) + 5 * k, F.lit(64)).cast("int"))
    flip = F.lit(0).cast("long")
    for k in range(8):
        flip = flip.bitwiseOR(F.when(F.pmod("id", F.lit(9)) > k, bit(k)).otherwise(F.lit(0).cast("long")))
    return h.unionByName(h.select((F.col("id") + 1_000_000).alias("id"), F.col("hash").bitwiseXOR(flip).alias("hash")))


def _flip() -> str:
    bit = lambda k: f"(CASE WHEN (id * {2 * k + 3} + {5 * k}) % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << ((id * {2 * k + 3} + {5 * k}) % 64) END)::BIGINT"
    return " | ".join(f"(CASE WHEN id % 9 > {k} THEN {bit(k)} ELSE 0 END)" for k in range(8))


@registry("dat6_phash_pairs", f"""WITH h0 AS (SELECT vec_id AS id, {_HASH} AS hash FROM embeddings), h AS (SELECT * FROM h0 UNION ALL SELECT id + 1000000, xor(hash, ({_flip()})::BIGINT) FROM h0)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 6""")
def dat6(spark, sf):
    return lsh.covered_pairs(reencoded_hashes(spark, sf))


@registry("dat6_phash_pairs_wide", f"""WITH h AS (SELECT vec_id AS id, {_HASH} AS hash FROM embeddings)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 18""")
def dat6_wide(spark, sf):
    return lsh.near_pairs(hashes(spark, sf), max_dist=18, bands=19)


@registry("dat7_quality_bucket", "SELECT event_id, CASE WHEN value IS NULL THEN 'native' WHEN value >= 90 THEN 'q_high' WHEN value >= 65 THEN 'q_mid' ELSE 'q_low' END AS quality FROM events")
def dat7(spark, sf):
    return table(spark, sf, "events").select("event_id", S.quality_bucket(F.col("value")).alias("quality"))


@registry("io1_csv_manifest", f"SELECT path, label, generator, family, source_id, media_type, quality, split FROM {SPLIT_SQL} v")
def io1(spark, sf):
    with scratch.folder(spark, "csv") as path:
        io.write_csv(divided(spark, sf).select(F.translate("path", "/", "\\").alias("path"), *split.MANIFEST[1:]), path)  # as another system wrote it
        return scratch.kept(io.read_manifest(spark, path), "csv-read")


@registry("io3_json_map", "SELECT 'user/' || user_id || '.wav' AS key, round(sum(value), 4) AS gain, count(*) AS clips FROM events GROUP BY user_id")
def io3(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("gain"), F.count(F.lit(1)).alias("clips"))
    entry = F.struct(F.concat(F.lit("user\\"), "user_id", F.lit(".wav")), F.struct("gain", "clips"))
    logs = per.groupBy(F.pmod("user_id", F.lit(64)).alias("log")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    with scratch.folder(spark, "logs") as path:
        logs.select("value").repartition(8).write.option("lineSep", "\n").text(path)  # a file a task, with several objects
        one = spark.read.text(path)  # one object a file is what the reader takes: a folder for each
        one.withColumn("log", F.pmod(F.xxhash64("value"), F.lit(1 << 30))).repartition("log").write.partitionBy("log").text(f"{path}/each")
        return scratch.kept(io.read_json_map(spark, f"{path}/each/*", "struct<gain:double,clips:bigint>"), "logs-read")


def planted_tree(spark, rel, root: str) -> int:
    """Files (a byte each; Spark leaves out empty ones) of the relative paths in `rel` below a shared folder; how many."""

    def run(batches):
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(root)
        made = set()
        for b in batches:
            for p in b[0].to_pylist():
                if (folder := p.rsplit("/", 1)[0]) not in made:
                    where.create_dir(f"{at}/{folder}", recursive=True)
                    made.add(folder)
                with where.open_output_stream(f"{at}/{p}") as f:
                    f.write(b".")
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    # a table of few splits is dealt out over the cores: a file is more work than a row
    rel = rel.repartition(2 * spark.sparkContext.defaultParallelism)
    return rel.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


@registry("io6_tree_manifest", f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'piper/spk' || doc_id % 7 || '/a_' || doc_id || '.wav' WHEN doc_id % 9 = 1 THEN 'authentic/notes_' || doc_id || '.txt' ELSE 'authentic/n' || doc_id || '_x.MP4' END AS p FROM documents)
SELECT p AS path, CASE WHEN p LIKE 'authentic/%' THEN 0 ELSE 1 END AS label, split_part(p, '/', 1) AS generator, {_family_sql("split_part(p, '/', 1)")} AS family,
CASE WHEN doc_id % 2 = 0 THEN split_part(p, '/', 2) ELSE split_part(split_part(p, '/', 2), '_', 1) END AS source_id, CASE WHEN p LIKE '%.MP4' THEN 'video' ELSE 'audio' END AS media_type, 'native' AS quality FROM f WHERE p NOT LIKE '%.txt'""")
def io6(spark, sf):
    d = F.col("doc_id")
    p = F.when(d % 2 == 0, F.concat(F.lit("piper/spk"), d % 7, F.lit("/a_"), d, F.lit(".wav"))).when(d % 9 == 1, F.concat(F.lit("authentic/notes_"), d, F.lit(".txt"))).otherwise(F.concat(F.lit("authentic/n"), d, F.lit("_x.MP4")))
    with scratch.folder(spark, "tree") as root:
        planted_tree(spark, table(spark, sf, "documents").select(p.alias("rel")), root)
        return scratch.kept(io.scan_tree(spark, root), "tree-read")


@registry("io4_keyed_upsert", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(value * 2, 4) WHEN event_id % 2 = 0 THEN round(value, 4) END AS value, CASE WHEN event_id % 3 = 0 THEN 'again' END AS note FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def io4(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.round("value", 4).alias("value"))
    again = e.where("event_id % 3 = 0").select("event_id", F.round(F.col("value") * 2, 4).alias("value"), F.lit("again").alias("note"))
    with scratch.folder(spark, "keyed") as path:
        io.upsert(spark, path, e.where("event_id % 2 = 0"), "event_id")
        io.upsert(spark, path, again, "event_id")
        return scratch.kept(io.upsert(spark, path, again, "event_id"), "keyed-read")  # the second time changes nothing


@registry("ft3_reservoir", f"SELECT generator, id FROM (SELECT generator, id, row_number() OVER (PARTITION BY generator ORDER BY md5('0|' || generator || '|' || id), id) AS r FROM {LINES_SQL} v WHERE label = 1) WHERE r <= 50")
def ft3(spark, sf):
    return replay.reservoir(lines(spark, sf).where("label = 1"), "generator", "id", 50).select("generator", "id")


@registry("ft4_equal_share", f"""WITH b AS (SELECT generator, id, md5('0|' || generator || '|' || id) AS p FROM {LINES_SQL} v WHERE label = 1 AND generator <> 'gen2'),
r AS (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY p, id) AS r FROM b) SELECT generator, id FROM r WHERE r <= greatest(1, 30 // (SELECT count(DISTINCT generator) FROM b)) ORDER BY generator, p, id LIMIT 30""")
def ft4(spark, sf):
    return replay.sample(replay.reservoir(lines(spark, sf).where("label = 1"), "generator", "id", 500), "generator", "id", 30, "gen2").select("generator", "id")


@registry("ft5_mixed_batch", f"""WITH b AS (SELECT * FROM (SELECT generator, id, md5('0|' || generator || '|' || id) AS p, row_number() OVER (PARTITION BY generator ORDER BY md5('0|' || generator || '|' || id), id) AS r FROM {LINES_SQL} v WHERE label = 1) WHERE r <= 50),
w AS (SELECT floor(count(*) * 0.5::DOUBLE / 0.5::DOUBLE)::BIGINT AS n FROM {LINES_SQL} v WHERE label = 0), s AS (SELECT generator, id, row_number() OVER (ORDER BY generator, p, id) AS i FROM b, w WHERE r <= greatest(1, n // (SELECT count(DISTINCT generator) FROM b)))
SELECT generator, id, false AS replayed FROM {LINES_SQL} v WHERE label = 0 UNION ALL SELECT generator, id, true FROM s, w WHERE i <= n""")
def ft5(spark, sf):
    df = lines(spark, sf)
    buffer = replay.reservoir(df.where("label = 1"), "generator", "id", 50)
    return replay.mixed_batch(df.where("label = 0"), buffer, "generator", "id")


@registry("ft6_buffer_stats", f"SELECT generator, least(50, count(*)) AS n FROM {LINES_SQL} v WHERE label = 1 GROUP BY 1")
def ft6(spark, sf):
    return replay.reservoir(lines(spark, sf).where("label = 1"), "generator", "id", 50).groupBy("generator").agg(F.count(F.lit(1)).alias("n"))


@registry("ft7_cosine_schedule", "SELECT event_id AS step, round(CASE WHEN event_id < 900 THEN event_id / 900.0::DOUBLE ELSE 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (event_id - 900) / 8100.0::DOUBLE))) END, 6) AS lr FROM events")
def ft7(spark, sf):
    # an event is a step of a run of 9,000 steps; later ones stay at the end of the schedule
    return table(spark, sf, "events").select(F.col("event_id").alias("step"), r6(S.cosine_schedule(F.col("event_id"), 9000), "lr"))


@registry("prb4_consistency_guard", f"SELECT bool_and(abs(score - score::FLOAT::DOUBLE) <= 1e-6 + 1e-5 * abs(score::FLOAT::DOUBLE)) AS consistent, count(*) FILTER (abs(score - qty) > 1e-6 + 1e-5 * abs(qty)) AS unlike FROM {LINES_SQL} v")
def prb4(spark, sf):
    # scores against themselves in single precision (consistent) and against another score (not)
    near = lambda x, y: F.abs(x - y) <= 1e-6 + 1e-5 * F.abs(y)
    s, q = F.col("score"), F.col("qty")
    return lines(spark, sf).agg(F.bool_and(near(s, s.cast("float").cast("double"))).alias("consistent"), F.count_if(~near(s, q)).alias("unlike"))
