"""Token ids as flat binary files with 64-bit document offsets.

Format of a folder, files in the order of their numbers:

* ``part-NNNNN.bin``: the ids of the part's documents, one after another, as little-endian unsigned
  integers of 16 bits, or of 32 where the vocabulary has more than 65,536 ids. No header.
* ``part-NNNNN.off``: n + 1 little-endian unsigned 64-bit numbers for n documents: ids before each
  document *of all parts*, and after the last one.
* ``part-NNNNN.doc``: n little-endian signed 64-bit document ids (NULL_ID for a null id).
* ``manifest.json``: the parts with their numbers of documents and ids and their bases, the width.

Documents are dealt to parts by range of id, so part numbers and the order inside a part give the
order of all documents. Each task encodes its range and streams it to its own file; then the parts'
totals, a row each, are summed up to bases, and a second job writes the offsets. A task that runs
again writes the same bytes under a name of its own and moves it to the final one, so a lost
executor costs its parts only. Readers map a part into memory and cut documents out by the offsets.

Encoding: between a character that is no white space and a space there always is a cut of the byte
level tokenizer's own splitting, so texts are cut there, and each distinct piece is encoded by the
library once and kept, as packed ids, in a bounded memo of the worker; texts are then put together from
the pieces' ids as arrays. The ids equal those of whole texts (compared in tests).
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ranges, read, release, scratch_root, slices

END_ID = 2
#: Pieces in the memo of a worker.
MEMO = 1 << 19
#: Stands for a null id in the files.
NULL_ID = -(1 << 63)
#: Bytes of text that are encoded at once: the more, the fewer distinct pieces a byte.
_SLICE = 1 << 22
#: Ids that a reader cuts out of a file at once.
_AT_ONCE = 1 << 22
_BETWEEN_SPACES = re.compile(r"\s (?:\s|\Z)")
_CUT = re.compile(r"(?<=\S)(?= )")
# ASCII signs: a run of them after letters is cut from these, and into nothing smaller
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte -> the letter that stands for it in byte-level vocabularies: itself if it is a printable
    sign, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


class Encoder:
    """Whole texts to ids of one tokenizer file, each with the end id after it."""

    def __init__(self, path: str, end_id: int = END_ID, memo: int = MEMO):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(width_of(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id))
        self.end, self.limit, self.young, self.old, self.signs = end_id, memo, {}, {}, {}
        before = self.tokenizer.pre_tokenizer
        # only a byte-level tokenizer without normaliser is known to cut where a space begins
        self.cuts = self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and not before.add_prefix_space and before.use_regex
        self.by_word = Tokenizer(self.tokenizer.model)  # words in byte letters, a space between them
        self.by_word.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.letters = _byte_letters()

    def pieces(self, text: str) -> list[str]:
        """Pieces whose ids, one after another, are those of the text."""
        if not self.cuts:
            return [text]
        if _BETWEEN_SPACES.search(text):
            return _CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def whole(self, text: str) -> bytes:
        """Packed ids of a text of which nothing is known, piece by piece if it is long."""
        pieces = self.pieces(text)
        runs = ["".join(pieces[at : at + (1 << 16)]) for at in range(0, len(pieces), 1 << 16)]
        return b"".join(np.array(self.tokenizer.encode(r, add_special_tokens=False).ids, self.dtype).tobytes() for r in runs)

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece with a space before it. A word with signs after it is a word and its
        signs, and many words are encoded at once; any other piece is encoded by itself. What half a
        memo's worth of newer pieces has not needed is forgotten."""
        if len(self.young) > self.limit // 2:
            self.old, self.young = self.young, {}
        young, old, signs_of = self.young, self.old, self.signs
        out = list(map(young.get, pieces))
        words, others, composed = {}, {}, []
        for i in [i for i, x in enumerate(out) if x is None]:
            p = pieces[i]
            word = p.rstrip(_SIGNS)
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                composed.append((i, word, p[len(word) :]))
                if word not in young:
                    if word in old:
                        young[word] = old[word]
                    else:
                        words[word] = None
            elif p in old:
                out[i] = young[p] = old[p]
            else:
                others[p] = None
        words = list(words)
        for at in range(0, len(words), 1 << 14):
            some = words[at : at + (1 << 14)]
            text = " ".join(["\u0120" + x if x.isascii() else "\u0120" + x.encode().decode("latin-1").translate(self.letters) for x in some])
            got = self.by_word.encode(text, add_special_tokens=False)
            packed = np.array(got.ids, self.dtype).tobytes()
            edges = (np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(some) + 1)) * self.dtype.itemsize).tolist()
            young.update(zip(some, [packed[i:j] for i, j in zip(edges, edges[1:])]))
        for i, word, signs in composed:
            if signs:
                tail = signs_of.get(signs)
                if tail is None:
                    tail = self.whole(signs)
                    if len(signs_of) < self.limit // 16:
                        signs_of[signs] = tail
                out[i] = young[word] + tail
            else:
                out[i] = young[word]
        if others:
            names = list(others)
            for p, got in zip(names, self.tokenizer.encode_batch_fast([" " + p for p in names], add_special_tokens=False)):
                young[p] = np.array(got.ids, self.dtype).tobytes()
            for i, x in enumerate(out):
                if x is None:
                    out[i] = young[pieces[i]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (string, no nulls), end ids included, and the ids of each text."""
        n = len(texts)
        if not n:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        whole = texts.to_pylist()
        odd = [i for i, t in enumerate(whole) if not self.cuts or _BETWEEN_SPACES.search(t)]
        if odd:  # their pieces are not what lies between single spaces
            mask = np.zeros(n, bool)
            mask[odd] = True
            texts = pa.compute.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        split = pa.compute.split_pattern(texts, " ")
        codes = pa.compute.dictionary_encode(split.flatten())
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        first = [t[: t.find(" ")] if " " in t else t for t in whole]
        for i in odd:
            first[i] = ""
        packed = self.ids_of(codes.dictionary.to_pylist())
        distinct = len(packed)
        packed += [np.array(got.ids, self.dtype).tobytes() for got in self.tokenizer.encode_batch_fast(first, add_special_tokens=False)]
        for i in odd:
            packed[distinct + i] = self.whole(whole[i])
        packed.append(np.array([self.end], self.dtype).tobytes())
        which = codes.indices.to_numpy().astype(np.int64)
        which[starts] = distinct + np.arange(n)  # a text's first piece has no space before it
        which = np.insert(which, np.r_[starts[1:], len(which)], len(packed) - 1)
        starts = starts + np.arange(n)
        sizes = np.array(list(map(len, packed)), np.int64) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(packed), self.dtype)[ranges((np.cumsum(sizes) - sizes)[which], sizes[which])]
        return ids, np.add.reduceat(sizes[which], starts)


@lru_cache(1)
def encoder_of(path: str, end_id: int = END_ID) -> Encoder:
    """The encoder of this process: the tasks that a worker runs in turn share its memo."""
    return Encoder(path, end_id)


def width_of(vocabulary_size: int, end_id: int = END_ID) -> str:
    return "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def _opened(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else fs.FileSystem.from_uri(f"file://{folder}")


def _put(folder: str, name: str, chunks) -> None:
    """Write a file under a name of its own, then move it to `name`; the last of several writers of
    the same bytes stays."""
    where, at = _opened(folder)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    where.move(own, f"{at}/{name}")


def _mapped(folder: str, name: str, dtype: str):
    """A file of numbers: mapped into memory where the file system is local, else fetched by range."""
    from pyarrow import fs

    where, at = _opened(folder)
    size = where.get_file_info(f"{at}/{name}").size // np.dtype(dtype).itemsize
    if isinstance(where, fs.LocalFileSystem):
        numbers = np.memmap(f"{at}/{name}", dtype, "r") if size else np.empty(0, dtype)
        return size, lambda a, b: numbers[a:b]
    file, width = where.open_input_file(f"{at}/{name}"), np.dtype(dtype).itemsize
    return size, lambda a, b: np.frombuffer(file.read_at((b - a) * width, a * width), dtype)


class TokenFiles:
    """A written folder: `parts`, rows of (part, docs, ids, base), and the integers' width."""

    def __init__(self, folder: str, dtype: str, parts: list[dict]):
        self.folder, self.dtype, self.parts = folder, dtype, parts

    @classmethod
    def open(cls, folder: str) -> "TokenFiles":
        where, at = _opened(folder)
        with where.open_input_stream(f"{at}/manifest.json") as f:
            found = json.loads(f.read())
        return cls(folder, found["dtype"], found["parts"])

    @property
    def n_ids(self) -> int:
        return sum(p["ids"] for p in self.parts)

    def documents(self, part: int):
        """doc_id (None for null), start among all ids, ids, of each document of a part in order. Ids
        are views of the mapped file, so a document of any length costs no memory of its own."""
        n, ids = _mapped(self.folder, f"part-{part:05d}.doc", "<i8")
        _, offsets = _mapped(self.folder, f"part-{part:05d}.off", "<u8")
        _, tokens = _mapped(self.folder, f"part-{part:05d}.bin", self.dtype)
        base = int(offsets(0, 1)[0])
        for at in range(0, n, 1 << 16):
            to = min(n, at + (1 << 16))
            edges = offsets(at, to + 1).tolist()
            for doc, a, b in zip(ids(at, to).tolist(), edges, edges[1:]):
                yield None if doc == NULL_ID else doc, a, b - a, lambda i, j, a=a: tokens(a - base + i, a - base + j)

    def rows(self, spark: SparkSession) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
        folder, dtype, parts = self.folder, self.dtype, self.parts
        table = spark.createDataFrame([(p["part"], p["docs"]) for p in parts], "part int, docs long").repartition(max(1, len(parts)), "part")

        def run(batches):
            files = TokenFiles(folder, dtype, parts)
            for b in batches:
                for part in b["part"].to_pylist():
                    out = []
                    for doc, start, n, ids in files.documents(part):
                        crc = 0
                        for i in range(0, n, _AT_ONCE):
                            crc = zlib.crc32(ids(i, min(n, i + _AT_ONCE)).astype("<u4").tobytes(), crc)
                        out.append((doc, start, n, crc))
                        if len(out) == 1 << 14:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

        return table.select("part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, parts: int | None = None) -> TokenFiles:
    """Encode every whole text with the tokenizer file `path` and write the ids to `folder` (a
    shared one, by URI or path) in ascending order of id.

    A null text is empty: the end id alone. Null ids come first; rows that share an id lie together,
    in an order given by their texts; repeated rows are written each time. A third of all rows may
    share one id: ranges are of (id, digest of the text). An empty table gives a folder without
    parts. Extra columns are left out. Texts of any length are encoded whole; a part's bytes stream
    to its file, its document ids and lengths (16 bytes a document) are held until it ends. The driver
    sees a row a part.
    """
    spark = docs.sparkSession
    path = path or vocabulary()
    where, at = _opened(folder)
    where.create_dir(at, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).withColumn("h", F.xxhash64("t"))
    if parts is None:
        parts = max(rows.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(parts, "i", "h").sortWithinPartitions("i", "h", "t").select("i", "t")

    def run(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_of(path, end_id)
        ids, sizes = [], []

        def chunks():
            gc.disable()  # strings by the million and no cycles among them
            try:
                for batch in batches:
                    for b in slices(batch, "t", _SLICE):
                        tokens, n = encoder.encode(b["t"].fill_null(""))
                        ids.append(b["i"].fill_null(NULL_ID).to_numpy())
                        sizes.append(n)
                        yield tokens.tobytes()
            finally:
                gc.enable()

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        _put(folder, f"part-{part:05d}.bin", (c for s in ([first], stream) for c in s))
        n = np.concatenate(sizes).astype("<u8")
        _put(folder, f"part-{part:05d}.doc", [np.concatenate(ids).astype("<i8").tobytes()])
        _put(folder, f"part-{part:05d}.len", [n.tobytes()])
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (part, len(n), int(n.sum()))], names=["part", "docs", "ids"])

    found, base = [], 0
    for r in sorted(rows.mapInArrow(run, "part long, docs long, ids long").collect()):
        found.append({"part": r["part"], "docs": r["docs"], "ids": r["ids"], "base": base})
        base += r["ids"]

    def offsets(batches):
        for b in batches:
            for part, base in zip(b["part"].to_pylist(), b["base"].to_pylist()):
                _, lengths = _mapped(folder, f"part-{part:05d}.len", "<u8")
                n = np.array(lengths(0, None), np.uint64)
                _put(folder, f"part-{part:05d}.off", [(np.r_[np.uint64(0), np.cumsum(n, dtype=np.uint64)] + np.uint64(base)).astype("<u8").tobytes()])
                yield pa.record_batch([pa.array([part], pa.int64())], names=["part"])

    if found:
        bases = spark.createDataFrame([(p["part"], p["base"]) for p in found], "part long, base long").repartition(len(found), "part")
        bases.mapInArrow(offsets, "part long").count()
    for p in found:
        if where.get_file_info(f"{at}/part-{p['part']:05d}.len").is_file:
            where.delete_file(f"{at}/part-{p['part']:05d}.len")
    dtype = width_of(_size(path), end_id)
    _put(folder, "manifest.json", [json.dumps({"dtype": dtype, "end_id": end_id, "parts": found}).encode()])
    return TokenFiles(folder, dtype, found)


def _size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    files = write(read(spark, sf_dir, "documents"), folder)
    out, _ = materialize(files.rows(spark), "token-rows")
    release(spark, folder)
    return out
