"""Readers and writers: manifests, scored frames, keyed logs and tables, directory trees, clips, vectors."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normalise_path
from . import scratch

_S = T.StringType()
MANIFEST_SCHEMA = T.StructType([T.StructField("path", _S), T.StructField("label", T.IntegerType()), *(T.StructField(c, _S) for c in ("generator", "family", "source_id", "media_type", "quality", "split"))])
# File extensions of media and the media type of those that are not images.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "mp4", "mov", "wav", "flac", "mp3")
MEDIA = {"mp4": "video", "mov": "video", "wav": "audio", "flac": "audio", "mp3": "audio"}


def read_manifest(spark: SparkSession, path: str, extra: dict[str, T.DataType] | None = None) -> DataFrame:
    """A CSV manifest by its schema, never inferred; paths get forward slashes."""
    schema = T.StructType([*MANIFEST_SCHEMA.fields, *(T.StructField(k, v) for k, v in (extra or {}).items())])
    return spark.read.schema(schema).csv(path, header=True).withColumn("path", normalise_path(F.col("path")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and the value's fields of files that each hold one JSON object keyed by path; `value` is
    the DDL of a value, such as 'struct<gain:double>' or 'string'."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v"))
    return whole.select(normalise_path(F.col("key")).alias("key"), "v.*" if value.startswith("struct") else F.col("v").alias("value"))


#: Folders that a keyed table is dealt to by its key's hash.
PARTS = 64


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Write rows into the keyed table at path, replacing those of the same key, and return the table.

    A key's hash tells its folder. Only the folders that rows fall into are read and written again,
    each as a whole when the job commits, so readers see a folder before or after, and a job that is
    run again writes the same. A key that `rows` holds more than once keeps its greatest row. New
    columns are null in old rows, and the other way round. `parts` is the table's for good.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    values = F.struct(*[c for c in rows.columns if c != key])
    rows = rows.groupBy(key).agg(F.max(values).alias("__v")).select(key, "__v.*").withColumn("part", part)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.option("mergeSchema", "true").parquet(path)
        if "part" not in old.columns:
            raise ValueError(f"{path} holds a table that was not written by upsert")
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # `parts` numbers at most
        stay = old.where(F.col("part").isin(touched)).join(rows.select(key), key, "left_anti")
        rows = stay.unionByName(rows, allowMissingColumns=True)
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return keyed_table(spark, path)


def keyed_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that `upsert` wrote."""
    return spark.read.option("mergeSchema", "true").parquet(path).drop("part")


def missing_keys(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not found."""
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


#: Entries of a directory that a lister hands on at once.
_ENTRIES = 8192


def _entries(root: str, rel: str):
    """(relative path, is a directory) of what stands in a directory below root, one after another; what
    Spark's readers pass over (hidden names, empty files) is left out."""
    import os

    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(root)
    folder = f"{at.rstrip('/')}/{rel}".rstrip("/")
    if isinstance(where, fs.LocalFileSystem):  # as a stream, however many there are
        with os.scandir(folder) as found:
            for e in found:
                if not _hidden(e.name) and (e.is_dir() or e.stat().st_size > 0):
                    yield f"{rel}/{e.name}" if rel else e.name, e.is_dir()
        return
    for e in where.get_file_info(fs.FileSelector(folder)):
        if not _hidden(e.base_name) and (e.type == fs.FileType.Directory or e.size != 0):
            yield f"{rel}/{e.base_name}" if rel else e.base_name, e.type == fs.FileType.Directory


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """A manifest of a directory tree (no split): the first part of the path below root is the
    generator, the second the source if there are three parts or more, else the file name up to its
    first underscore. Contents are not read.

    Directories are listed in tasks, a level of the tree at a time; a file is a row from the start and is
    never opened. On a file system that pyarrow can't open Spark's own reader lists the tree."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        prefix = root.rstrip("/").removeprefix("file://").removeprefix("file:") + "/"
        return manifest_of(files.withColumn("rel", F.element_at(F.split("path", _quoted(prefix), 2), 2)), "rel")

    def listed(batches):
        from itertools import islice

        for b in batches:
            for rel in b[0].to_pylist():
                found = _entries(root, rel)
                while some := list(islice(found, _ENTRIES)):
                    yield pa.record_batch([pa.array([x for x, _ in some], pa.string()), pa.array([d for _, d in some], pa.bool_())], names=["rel", "dir"])

    level, files = spark.range(1).select(F.lit("").alias("rel")), None
    while True:
        found = scratch.kept(level.mapInArrow(listed, "rel string, dir boolean"), "tree-level")
        here = found.where(~F.col("dir")).select("rel")
        files = here if files is None else files.unionByName(here)
        level = found.where("dir").select("rel")
        if level.isEmpty():
            return manifest_of(files, "rel")
        level = level.repartition(2 * spark.sparkContext.defaultParallelism)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def manifest_of(files: DataFrame, rel: str) -> DataFrame:
    """Manifest columns but split, from relative paths."""
    from ..functions.scalars import family_of

    path = normalise_path(F.col(rel))
    parts = F.split(path, "/")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    media = F.lit("image")
    for k, v in MEDIA.items():
        media = F.when(ext == k, v).otherwise(media)
    gen = F.element_at(parts, 1)
    out = files.where(ext.isin(*EXTENSIONS) & (F.size(parts) >= 2))
    return out.select(
        path.alias("path"),
        F.when(gen == "authentic", 0).otherwise(1).alias("label"),
        gen.alias("generator"),
        family_of(gen).alias("family"),
        F.when(F.size(parts) >= 3, F.element_at(parts, 2)).otherwise(F.substring_index(stem, "_", 1)).alias("source_id"),
        media.alias("media_type"),
        F.lit("native").alias("quality"),
    )


def to_mono(x: np.ndarray) -> np.ndarray:
    """Mean over channels; the first axis is taken for them if it is short and the shorter one."""
    x = np.asarray(x, np.float64)
    if x.ndim == 1:
        return x
    return x.mean(axis=0 if x.shape[0] <= 8 and x.shape[0] < x.shape[1] else 1)


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples in [-1, 1) of 16-bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return w.getframerate(), to_mono(x / 32768.0)


def decode_any(df: DataFrame, value: str, files: DataFrame | None = None) -> DataFrame:
    """df with sr and samples in place of `value`, a struct that has a clip in one of several shapes: `array`
    with `sampling_rate`, `bytes` of a WAV file, or the `path` of one among files (path, content).
    The first of these that is there counts; a clip in none of them raises."""
    fields = df.schema[value].dataType.names
    has = lambda f, kind: F.col(value)[f] if f in fields else F.lit(None).cast(kind)
    raw = has("bytes", "binary")
    if files is not None and "path" in fields:
        found = files.select(F.col("path").alias("__p"), F.col("content").alias("__c"))
        df = df.join(found, has("path", "string") == F.col("__p"), "left").drop("__p")
        raw = F.coalesce(raw, F.col("__c"))
    wav = F.when(has("array", "array<float>").isNull(), F.when(raw.isNull(), F.raise_error(F.lit("a clip has neither samples, bytes nor a known file")).cast("binary")).otherwise(raw))

    @F.pandas_udf("sr int, samples array<float>")
    def decoded(content: pd.Series) -> pd.DataFrame:
        got = [decode_wav(c) if c is not None else (None, None) for c in content]
        return pd.DataFrame({"sr": pd.Series([g[0] for g in got], dtype="Int32"), "samples": [None if g[1] is None else g[1].astype(np.float32) for g in got]})

    out = df.withColumn("__d", decoded(wav))
    sr, samples = F.coalesce(F.col("__d.sr"), has("sampling_rate", "int").cast("int")), F.coalesce(F.col("__d.samples"), has("array", "array<float>").cast("array<float>"))
    return out.withColumn("sr", sr).withColumn("samples", samples).drop("__d", "__c", value)


def encode_wav(x, sr: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(np.clip(np.rint(np.asarray(x, float) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def write_wav(df: DataFrame, folder: str) -> int:
    """A 16-bit PCM file below a shared folder (a URI) for each row (name, sr, samples); how many. A task
    that runs again writes the same files, each under a name of its own first."""

    def run(batches):
        import uuid

        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        for b in batches:
            for name, sr, x in zip(b["name"], b["sr"], b["samples"]):
                own = f"{at}/.{uuid.uuid4().hex}"
                with where.open_output_stream(own) as out:
                    out.write(encode_wav(x, int(sr)))
                where.move(own, f"{at}/{name}")
            yield pd.DataFrame({"n": [len(b)]})

    return df.select("name", "sr", "samples").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, sr, samples of WAV files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)

    def run(batches):
        for b in batches:
            got = [decode_wav(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "sr": [g[0] for g in got], "samples": [g[1].astype(np.float32) for g in got]})

    return files.select("path", "content").mapInPandas(run, "path string, sr int, samples array<float>")


def write_vectors(df: DataFrame, path: str) -> None:
    """(path, layer, vec) as Parquet by layer, so that a layer's reader prunes the rest. Layers that are
    written again replace their own folder and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def read_vectors(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    """(path, layer, vec) of some layers, or all; folders of other layers are not listed by the scan."""
    df = spark.read.parquet(path)
    return df if layers is None else df.where(F.col("layer").isin(layers))


def missing_vectors(wanted: DataFrame, spark: SparkSession, path: str, key: str = "path") -> DataFrame:
    """Rows of wanted (key, layer) that the store does not hold yet."""
    return wanted.join(spark.read.parquet(path).select(key, "layer"), [key, "layer"], "left_anti")
