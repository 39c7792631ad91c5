"""Spelling variants: words within one edit of each other, found by Aho-Corasick over word halves.

A word that one edit turns into another leaves one of its halves whole: the first half then stands
at the start of the other word, the second one at its end. So every word is cut in two, automatons
hold the halves, every word is scanned by them, and a half that is met counts only at its own offset
(start or end) in a word whose length differs by one at most; what is left is verified.

Shards: a half is dealt by (which half, its word's length, its first three code points); a scanned
word can only meet halves of three lengths at two offsets, so it goes to six such keys and no word
is scanned by all shards. A key with more than SHARD halves is cut into parts, each a shard's, and
its scanned words go to every part. A task builds an automaton for up to SHARD halves at a time and
scans its words in batches.

Many words may share a half (all words of one long stem do). Where more than FEW do, the rests of
their words are looked up by what is left of them without one code point, at the same place, in
place of being compared one by one, so the work follows the words and not their pairs.

A scanned word leaves a task as one row a key: its number of near words there and the most frequent
of them. Roots come from joining forms with themselves; a form is five times as frequent as its
word, so a chain is no longer than the logarithm of the largest count.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, release, slices, spread

MIN_CHARS, MIN_COUNT, RATIO, TYPO = 6, 5, 5, 199
#: Halves in one automaton; words with one half in common that are compared one by one; distinct
#: words that a task counts before it hands the counts on.
SHARD, FEW, TALLY = 100_000, 24, 1 << 18
_PREFIX = 3
# Latin-1 bytes: A-Z to lower case, other letters as they are, all else to a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_in(doc_id: int | None, text: str | None, min_chars: int = MIN_CHARS, typo: int = TYPO) -> Counter:
    """Latin-1 bytes -> occurrences of the words of one text: runs of A-Z, a-z and U+00C0 to U+00FF,
    only A-Z lower-cased. A run loses its code point number h % length if `typo` divides h, the crc32
    of its id and itself."""
    out: Counter = Counter()
    if not text:
        return out
    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(_FOLD).split()).items():
        if len(run) < min_chars:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % typo == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_chars:
                continue
        out[run] += n
    return out


def frequent_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """word, n: the words of at least min_chars code points with at least min_count occurrences."""

    def run(batches):
        total: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for b in slices(batch, "t"):
                for i, t in zip(b["i"].to_pylist(), b["t"]):
                    for w, n in words_in(i, t.as_py(), min_chars, typo).items():
                        total[w] += n
                if len(total) > TALLY:
                    yield flush()
        yield flush()

    rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


class Owners:
    """The words of one length that share one half; `half` is 0 for the first and 1 for the second."""

    def __init__(self, half: int, cut: int):
        self.half, self.cut, self.words, self.counts, self.by_rest = half, cut, [], [], None

    def rest(self, word: str) -> str:
        return word[self.cut :] if self.half == 0 else word[: len(word) - self.cut]

    def _index(self):
        """Rests, and rests without one code point by its place."""
        self.by_rest = defaultdict(list)
        for i, w in enumerate(self.words):
            r = self.rest(w)
            self.by_rest[r].append(i)
            for p in range(len(r)):
                self.by_rest[p, r[:p] + r[p + 1 :]].append(i)

    def near(self, word: str) -> list[int]:
        """Numbers of the words near to one that has the half at its place."""
        if len(self.words) <= FEW:
            return [i for i, w in enumerate(self.words) if near(w, word)]
        if self.by_rest is None:
            self._index()
        r, longer, found = self.rest(word), len(word) - len(self.words[0]), self.by_rest
        if longer == 1:
            keys = {r[:p] + r[p + 1 :] for p in range(len(r))}
        elif longer == 0:
            keys = {(p, r[:p] + r[p + 1 :]) for p in range(len(r))}
        else:
            keys = {(p, r) for p in range(len(r) + 1)}
        got = {i for k in keys if k in found for i in found[k]}
        return [i for i in got if self.words[i] != word]


class Automaton:
    """Aho-Corasick over the halves of some words."""

    def __init__(self):
        import ahocorasick

        self.machine, self.owners, self.size = ahocorasick.Automaton(), [], 0

    def add(self, half: int, word: str, n: int) -> None:
        cut = len(word) // 2
        segment = word[:cut] if half == 0 else word[cut:]
        groups = self.machine.get(segment, None)
        if groups is None:
            self.machine.add_word(segment, groups := {})
        group = groups.get((half, len(word)))
        if group is None:
            group = groups[half, len(word)] = Owners(half, len(segment))
        group.words.append(word)
        group.counts.append(n)
        self.size += 1

    def scan(self, word: str, half: int, length: int) -> tuple[int, int, str] | None:
        """Number of near words of one length that have this half in common with `word`, and the most
        frequent of them, ties to the smallest. Words with the first half in common, too, are left to that half."""
        cut = length // 2
        size = cut if half == 0 else length - cut
        want = (cut if half == 0 else len(word)) - 1
        if len(word) < size:
            return None
        for end, groups in self.machine.iter(word):
            if end != want or (group := groups.get((half, length))) is None or group.cut != size:
                continue
            found = [(-group.counts[i], group.words[i]) for i in group.near(word) if half == 0 or group.words[i][:cut] != word[:cut]]
            if found:
                n, best = min(found)
                return len(found), -n, best
        return None


def _partners(batches):
    """Rows (shard, half, length, word, n, scanned) in order of shard, halves before scanned words: one row of each
    scanned word with partners."""
    machine, shard, ready = None, None, False
    for b in batches:
        out = []
        for s, half, length, word, n in zip(*(b[c].to_pylist() for c in ("shard", "half", "length", "word", "n"))):
            if s != shard:
                machine, shard, ready = Automaton(), s, False
            if n is not None:
                machine.add(half, word, n)
                continue
            if not ready:
                if machine.size:
                    machine.machine.make_automaton()
                ready = True
            if machine.size and (found := machine.scan(word, half, length)):
                out.append((word, *found))
        cols = list(zip(*out)) or [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, shard_halves: int = SHARD) -> DataFrame:
    """word, n_near, best_n, best for each of the words (word, n; distinct) that has a near one."""
    spark = words.sparkSession
    size, prefix = F.length("word"), min(_PREFIX, max(1, min_chars // 2))
    cut = F.floor(size / 2).cast("int")
    key = lambda half, length, at: F.struct(F.lit(half).alias("half"), length.cast("int").alias("length"), F.substring("word", at + 1, F.lit(prefix)).alias("start"))
    halves = words.select("word", "n", F.explode(F.array(key(0, size, F.lit(0)), key(1, size, cut))).alias("key")).select("key.*", "word", "n")
    others = [F.when(size + d >= min_chars, key(h, size + d, F.lit(0) if h == 0 else F.floor((size + d) / 2).cast("int") - d)) for d in (-1, 0, 1) for h in (0, 1)]
    scans = words.select("word", F.explode(F.array_compact(F.array(*others))).alias("key")).select("key.*", "word", F.lit(None).cast("long").alias("n"))
    on = ["half", "length", "start"]
    counted = halves.groupBy(*on).agg(F.count(F.lit(1)).alias("k"))
    counted, path = materialize(counted, "spelling-keys")
    total = counted.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-2 * total // shard_halves))
    parts = counted.select(*on, F.greatest(F.lit(1), F.ceil(F.col("k") * 2 / shard_halves)).cast("int").alias("parts"))
    dealt = halves.join(parts, on).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    met = scans.join(parts, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))  # keys without halves fall out
    both = dealt.unionByName(met).withColumn("shard", F.pmod(F.xxhash64(*on, "part"), F.lit(shards)))
    rows = both.select("shard", "half", "length", "word", "n").repartition(int(shards), "shard").sortWithinPartitions("shard", F.col("n").isNull())
    found = rows.mapInArrow(_partners, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))
    found, _ = materialize(found, "spelling-near")
    release(spark, path)
    return found


def _roots(forms: DataFrame) -> tuple[DataFrame, str]:
    """word, root for words with a form (word, form): pointers take over their goal's until none moves."""
    spark = forms.sparkSession
    cur, path = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt, nxt_path = materialize(cur.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        release(spark, path)
        cur, path = nxt.select("word", "root"), nxt_path
        if nxt.where("moved").isEmpty():
            return cur, path


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, typo: int = TYPO, shard_halves: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n for each frequent word.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is
    at least `ratio` times the word's own; its root is the last word along the forms, itself if it has
    none. Null and empty texts have no words; a null id counts as the text `null` in the hash.
    Repeated rows count each. Texts and words of any length are taken whole. An empty table gives an
    empty result. Extra columns are left out. ratio: at least 2, so that forms make no ring.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    spark = docs.sparkSession
    words, words_path = materialize(frequent_words(docs, id_col, text_col, min_chars, min_count, typo), "spelling-words")
    found = near_words(words, min_chars, shard_halves)
    out = words.join(found, "word", "left").withColumn("has", F.col("best_n") >= ratio * F.col("n"))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n"))
    out, out_path = materialize(out, "spelling-forms")
    roots, roots_path = _roots(out.where("form is not null"))
    out = out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out, _ = materialize(out, "spelling-variants")
    release(spark, words_path, out_path, roots_path)
    return out


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))
