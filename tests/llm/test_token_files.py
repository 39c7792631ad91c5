"""op12: ids and files against the tokenizer library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sondera.llm import queries
from sondera.llm import token_files as T

SF = "/root/testdata/sf0.001"
PARTS = [" ", "  ", "\n", "\t", "a", "b c", "'s", "1", ".", "é", "\x1c", "\xa0", "　", " \n ", "<|endoftext|>", "中", "​", "\x85", "Zoë", " don't,", " x_", "<|", "|>", "Ġ", "ª", " Straße!", "\r\n", "..."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.vocabulary())


def wanted(library, rows):
    """(doc_id, start, n_tokens, ids_crc32) in file order."""
    out, at = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("memo", [4, 1 << 19])
def test_ids_equal_those_of_whole_texts(library, memo):
    rng = random.Random(0)
    encoder = T.Encoder(T.vocabulary(), memo=memo)
    for _ in range(1500):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 4))]
        ids, sizes = encoder.encode(pa.array(texts, pa.string()))
        want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w], texts


def test_other_tokenizers_take_the_library_path():
    path = T.vocabulary("word_bpe_49k.json")
    texts = ["Some  TEXT, here", "", "a\n b"]
    ids, sizes = T.Encoder(path).encode(pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))


def test_width_follows_the_vocabulary():
    assert [T.width_of(50_257), T.width_of(65_536), T.width_of(65_537), T.width_of(100, 70_000)] == ["<u2", "<u2", "<u4", "<u4"]


def test_files_are_flat_and_offsets_global(spark, library, tmp_path):
    rows = [(i, f"text number {i}, " * (i % 7)) for i in range(50)]
    folder = f"file://{tmp_path}/files"
    files = T.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, parts=5)
    want = wanted(library, rows)
    ids = np.concatenate([np.fromfile(tmp_path / f"files/part-{p['part']:05d}.bin", "<u2") for p in files.parts])
    offsets = [np.fromfile(tmp_path / f"files/part-{p['part']:05d}.off", "<u8") for p in files.parts]
    assert len(files.parts) > 1 and len(ids) == sum(w[2] for w in want) == files.n_ids
    assert all(a[-1] == b[0] for a, b in zip(offsets, offsets[1:])) and [p["base"] for p in files.parts] == [o[0] for o in offsets]
    assert np.concatenate([o[:-1] for o in offsets]).tolist() == [w[1] for w in want]
    assert sorted(map(tuple, T.TokenFiles.open(folder).rows(spark).collect())) == want
    assert not [p for p in (tmp_path / "files").iterdir() if p.name.startswith(".part") or p.suffix == ".len"]


def test_nulls_repeats_shared_ids_and_long_texts(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "_AT_ONCE", 1000)
    rows = [(7, "b"), (7, "a"), (7, "a"), (None, "null id"), (None, None), (3, ""), (2, "long text, " * 30_000), (1, None), (-5, " x  y ")]
    files = T.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/files", parts=3)
    got = sorted(map(tuple, files.rows(spark).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -5, 1, 2, 3, 7, 7, 7]
    left = list(rows)
    for doc, start, n, crc in got:
        match = next(r for r in left if r[0] == doc and wanted(library, [r])[0][2:] == (n, crc))
        left.remove(match)
    assert not left and [r[1] for r in got] == np.r_[0, np.cumsum([r[2] for r in got])[:-1]].tolist()


def test_empty_table_and_clashing_columns(spark, library, tmp_path):
    files = T.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert files.parts == [] and files.rows(spark).count() == 0
    df = spark.createDataFrame([(2, "two"), (1, "one")], "k long, v string").select(F.col("k").alias("a.k"), F.col("v").alias("the text"), F.lit(1).alias("i"), F.lit(2).alias("t"), F.lit(3).alias("h"), F.lit(4).alias("part"))
    files = T.write(df, f"file://{tmp_path}/some", id_col="a.k", text_col="the text")
    assert sorted(map(tuple, files.rows(spark).collect())) == wanted(library, [(1, "one"), (2, "two")])


def test_query_equals_the_library(spark, library):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = queries.queries()["op12_token_files"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == wanted(library, docs)
