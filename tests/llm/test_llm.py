"""The ten operators against brute force, on small tables with nulls, empties, ties and repeats."""

import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from sondera.llm import ann, decontaminate, html_text, induced, langid, line_dedup, mixing, near_copies, quality, simhash, substring_dedup, suffix_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs int, key string, `select` string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed=0, n=40):
    """Texts with copies, shared passages, nulls, empties and white space; ids are unique."""
    rng = random.Random(seed)
    shared, texts = words(rng, 60), []
    for i in range(n):
        t = words(rng, rng.randint(1, 90))
        if i % 4 == 0:
            t = words(rng, 5) + "\n" + shared + "\t" + t
        if i % 7 == 0 and texts:
            t = texts[-1] or t
        texts.append(t)
    texts[3], texts[5], texts[6], texts[9] = None, "", " \n\t ", "É 12 %%"
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "de", f"src{(i or 0) % 3}", 0, 1, "k", "s") for i, t in rows], SCHEMA)


def _sorted(raw):
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = [0] + [next((k for k in range(min(len(raw) - a, len(raw) - b)) if raw[a + k] != raw[b + k]), min(len(raw) - a, len(raw) - b)) for a, b in zip(order, order[1:])]
    return order, shared


@pytest.mark.parametrize("small", [False, True])
def test_suffix_order_and_common_prefixes(monkeypatch, tmp_path, small):
    if small:  # queues, columns and texts go to disk, and many symbols share a range
        for k, v in (("HELD", 20), ("BLOCK", 8), ("IN_MEMORY", 10), ("RANGES", 3.0)):
            monkeypatch.setattr(induced, k, v)
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60, 500):
        for top in (2, 4, 200):
            raw = rng.integers(1, top, n).astype(np.uint8).tobytes() + b"\0"
            text = np.frombuffer(raw, np.uint8).copy()
            order, shared = induced.sorted_suffixes(text, 257, induced.Room(str(tmp_path)))
            want, common = _sorted(raw)
            assert list(order) == want and list(shared) == common
    for n in (300, 3000):  # more symbols than ranges
        text = rng.integers(1, 2000, n) * rng.integers(1, 3, n)
        text = np.r_[text, np.tile(text[:40], 4), 5000, 0]
        order, shared = induced.sorted_suffixes(text, 5001, induced.Room(str(tmp_path)))
        want, common = _sorted(tuple(text.tolist()))
        assert list(order) == want and list(shared) == common


def test_suffix_sorter_is_bounded(monkeypatch):
    """A shard ten times the limit of what is held in memory: arrays are files, queues spill, and
    what Python holds stays far below the shard's own arrays."""
    import tracemalloc

    rng = random.Random(8)
    words_ = [bytes(rng.choice(b"abcdefgh ") for _ in range(40)) for _ in range(400)]
    segments = [b"".join(rng.choice(words_) for _ in range(9)) for _ in range(4000)]
    n = sum(map(len, segments))
    for k, v in (("HELD", 1 << 15), ("BLOCK", 1 << 14), ("IN_MEMORY", n // 10)):
        monkeypatch.setattr(induced, k, v)
    tracemalloc.start()
    got = induced.repeated_windows(segments, 120, np.ones(len(segments), int))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    from collections import Counter

    seen = Counter(s[i : i + 120] for s in segments for i in range(0, len(s) - 119))
    assert all(list(g) == [i for i in range(len(s) - 119) if seen[s[i : i + 120]] > 1] for s, g in zip(segments, got))
    assert peak < 25 * n, peak / n  # the arrays of a shard are over 60 bytes a symbol


def test_repeated_windows_from_disk(monkeypatch):
    monkeypatch.setattr(induced, "HELD", 40)
    monkeypatch.setattr(induced, "BLOCK", 16)
    monkeypatch.setattr(induced, "IN_MEMORY", 10)
    rng = random.Random(3)
    segments = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(50)]
    from collections import Counter

    seen = Counter(s[i : i + 8] for s in segments for i in range(len(s) - 7))
    got = induced.repeated_windows(segments, 8, np.ones(len(segments), int))
    assert [list(g) for g in got] == [[i for i in range(len(s) - 7) if seen[s[i : i + 8]] > 1] for s in segments]


@pytest.mark.parametrize("window", [12, 60])
def test_suffix_dedup(spark, window):
    rows = corpus()
    got = [tuple(r)[:5] for r in suffix_dedup.remove_repeats(frame(spark, rows), window=window).collect()]
    assert sorted(got) == sorted(brute.removed_bytes(rows, window))


def test_suffix_dedup_repeated_rows_and_long_texts(spark, monkeypatch):
    from sondera.llm import repeats

    rng = random.Random(1)
    long = words(rng, 3000)
    rows = [(1, long), (1, long), (2, words(rng, 50) + long[500:1500]), (None, "x" * 500), (3, None)]
    monkeypatch.setattr(repeats, "PIECE", 4096)
    got = [tuple(r)[1:5] for r in suffix_dedup.remove_repeats(frame(spark, rows), window=200).collect()]
    assert sorted(got) == sorted(x[1:] for x in brute.removed_bytes(rows, 200))


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, batches):
    rows = corpus(2)
    got = [tuple(r)[:4] for r in substring_dedup.remove_repeats(frame(spark, rows), window=6, batches=batches).collect()]
    assert sorted(got) == sorted(brute.removed_words(rows, 6))


def test_index_knows_history(spark):
    from sondera.llm.common import row_key
    from sondera.llm.repeats import runs_of

    index = substring_dedup.FingerprintIndex(spark, 6)
    runs = lambda rows: runs_of(frame(spark, rows).select(row_key("doc_id", "text").alias("key"), "text"), substring_dedup.word_tokens, 6, index.gram)
    text, other = words(random.Random(4), 80), words(random.Random(5), 80)
    first = index.sorted_run(runs([(1, text)]))
    assert index.known(first).count() == 0
    index.add(first)
    # the second text of a batch is told in the batch and, as it stood alone, in history
    told, _ = substring_dedup.repeats_with_history(index, runs([(2, text), (3, other)]))
    n = runs([(1, text)]).count()
    assert told.count() == 2 * n and told.select("key").distinct().count() == 2
    # no more than the third time's own rows: history has been told before
    assert substring_dedup.repeats_with_history(index, runs([(4, text)]))[0].count() == n
    # the merge-join of two runs has no shuffle
    plan = index.known(index.levels[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


def test_substring_dedup_repeated_rows_null_ids_and_long_texts(spark, monkeypatch):
    from sondera.llm import repeats

    rng = random.Random(6)
    long = words(rng, 3000)
    rows = [(1, long), (1, long), (None, words(rng, 20) + " " + " ".join(long.split()[100:300])), (None, None), (3, "")]
    monkeypatch.setattr(repeats, "PIECE", 1024)
    got = [tuple(r)[1:4] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(x[1:] for x in brute.removed_words(rows, 35))


def test_line_dedup(spark):
    rng = random.Random(5)
    base = [words(rng, 6) for _ in range(12)]

    def edited(s):
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(s))
            s = s[:p] + rng.choice(["", "z", s[p] + "y"]) + s[p + 1 :]
        return s

    rows = [(i, "\n".join(edited(rng.choice(base)) if rng.random() < 0.6 else words(rng, 3) for _ in range(5)) + "\n\nab") for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute.kept_lines(rows, line_dedup.MIN_CHARS, line_dedup.FUZZY_CHARS, 2)


def test_line_dedup_keeps_clashing_columns(spark):
    line = "the same long line of text here"
    df = spark.createDataFrame([(1, line, 5, 6), (2, line + "\n" + line, 7, 8)], "doc_id long, text string, __key int, __gone int")
    got = sorted(map(tuple, line_dedup.dedup_lines(df).select("doc_id", "text", "__key", "__gone", "n_removed").collect()))
    assert got == [(1, line, 5, 6, 0), (2, "", 7, 8, 2)]


def test_line_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "the same long line of text here"), (3, "the same long line of text here"), (None, "another line of some length")]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, t, 0) for i, t in rows), key=str)


def test_simhash_groups(spark):
    rows = corpus(6)
    long = words(random.Random(7), 300)
    rows += [(100, long), (101, long.replace("a", "b", 1)), (102, long.upper())]
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()))
    assert got == sorted(brute.near_groups(rows, 4))


def test_covering_sets():
    from itertools import combinations

    for most in range(1, 8):
        sets = simhash.covering(most)
        assert all(any(set(x) <= set(y) for x in sets) for y in combinations(range(8), 8 - most))


@pytest.mark.parametrize("block", [4, 1024])
def test_simhash_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(31)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(30)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()

    def groups(pairs):
        parent = {f: f for f in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {f: root(f) for f in fps}

    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in got]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert groups(pairs) == groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])


def test_simhash_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "A b c d e"), (7, "A b c d e"), (None, "x y z w q"), (8, "é É")]
    got = sorted(simhash.near_duplicates(frame(spark, rows)).collect(), key=str)
    a, x = (f"{brute.simhash(t):016x}" for t in ("a b c d e", "x y z w q"))
    e = f"{simhash.fingerprint('é É'):016x}"
    assert sorted(map(tuple, got), key=str) == sorted([(None, a, 7)] * 2 + [(7, a, 7)] * 2 + [(None, x, None), (8, e, 8)], key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 21), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8, 10: 8, 21: 20}


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, words(rng, 20).capitalize() + ". " + words(rng, 8).capitalize() + ".") for i in range(12)] + [(50, None), (51, ""), (52, "!!")]
    docs = [(i, words(rng, 200)) for i in range(8)]
    docs[2] = (2, docs[2][1] + " " + items[4][1] + " " + words(rng, 90))
    docs[3] = (3, items[7][1].upper().replace(" ", "\n"))
    docs[4] = (4, " ".join(items[1][1].split()[:14]))  # half a question is no leak
    docs += [(20, None), (21, "")]
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(2, 4), (3, 7)]
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()}
    blocks = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=60)
    # how the items are cut into blocks changes no score
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["score"], abs=1e-9) for r in blocks.collect()} == found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(19)
    vocab = words(rng, 300).split()
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(8, 30)).capitalize() + ". " + text(rng.randint(3, 9)).capitalize() + ".") for i in range(30)] + [(99, text(300) + ". " + text(10) + ".")]
    docs = []
    for i in range(25):
        w = text(rng.randint(20, 260)).split()
        for item in rng.sample(items, rng.randint(0, 2)):
            piece = item[1].split()
            for j in rng.sample(range(len(piece)), rng.randint(0, 3)):
                piece[j] = rng.choice(vocab)
            w[len(w) // 2 : len(w) // 2] = piece
        docs.append((i, " ".join(w)))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.leaks(docs, items, decontaminate)
    assert len(got) > 5 and {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


@pytest.mark.parametrize("kind,ids", [("smallint", [1, 2]), ("decimal(10,2)", ["1.50", "2.50"]), ("string", ["a", "b"])])
def test_decontamination_item_ids_of_any_type(spark, kind, ids):
    rng = random.Random(20)
    a, b = words(rng, 20) + ". " + words(rng, 8), words(rng, 20) + ". " + words(rng, 8)
    items = spark.createDataFrame([(ids[0], a), (ids[1], b), (ids[1], b)], "i string, text string").selectExpr(f"cast(i as {kind}) as item_id", "text", "1 as score")
    got = decontaminate.contaminated(frame(spark, [(1, words(rng, 40) + " " + b), (1, words(rng, 40) + " " + b), (None, a)]), items).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in got) == [("1", str(ids[1]))] * 2 + [("None", str(ids[0]))]


def test_wand_finds_all_above_threshold():
    rng = random.Random(9)
    vocab = [words(rng, 1) for _ in range(80)]
    index = decontaminate.ItemIndex([(i, " ".join(rng.choice(vocab) for _ in range(12))) for i in range(60)])
    for _ in range(30):
        terms = sorted({index.vocab[w] for w in (rng.choice(vocab) for _ in range(25)) if w in index.vocab})
        full = {}
        for t in terms:
            for i, x in zip(*index.postings[t]):
                full[i] = full.get(i, 0) + x
        got = {i for b in range(index.maxima.shape[1]) for i, _ in index.wand(terms, b, 0.4)}
        assert got == {i for i, s in full.items() if s >= 0.4 - 1e-6}


def test_ann_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:140] = x[5]  # one vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None] + [1.0] * 14), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 3000, 100):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in [m[1] for m in mine]
        assert all(abs(s[v] - sc) < 1e-9 for _, v, sc in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hit += len(set(want.tolist()) & {m[1] for m in mine})
    assert hit / 600 >= 0.9 and 9000 not in got and 9001 not in got


def _exact(x, ids, q, top):
    s = x.astype(float) @ x[q].astype(float)
    return [(int(ids[j]), s[j]) for j in sorted((j for j in range(len(x)) if j != q), key=lambda j: (-s[j], ids[j]))[:top]]


def test_ann_small_and_empty(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = ann.neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert ann.neighbours(df.where("false"), df.where("false")).count() == 0


def test_ann_doubles_lengths_signs_and_clashing_columns(spark):
    rows = [(1, [0.17, 0.1]), (2, [-1.0, 0.3]), (3, [1.0]), (4, [2.0, 0.5, 0.1]), (5, [1.0, 0.0]), (6, [-1.0, 0.3])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, v string")
    got = [(r["vec_id"], r["score"]) for r in ann.neighbours(df, df.where("vec_id = 3")).orderBy("rank").collect()]
    # the shorter vector ends in zeros; ties (2 and 6) go to the smaller id; doubles are exact
    assert got == [(4, 2.0), (5, 1.0), (1, 0.17), (2, -1.0), (6, -1.0)]


def test_ann_clustered_data_visits_little(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(100, 24))
    x = (np.repeat(centre, 40, axis=0) + rng.normal(size=(4000, 24)) * 0.05).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 100 = 0")
    got = {}
    for r in ann.neighbours(df, asked).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len({i for i, _ in _exact(x, range(4000), q, 20)} & got[q]) for q in range(0, 4000, 100))
    assert hit / 800 >= 0.9
    # share of the table that the fitted index scores for a query, over both tables
    norm = float(np.linalg.norm(x, axis=1).max())
    entries = df.selectExpr("embedding as v", "array(vec_id) as ids")
    index = ann.fit(entries, asked.selectExpr("vec_id as qid", "embedding as v"), 4000, 24, norm)
    scored = 0
    for t in range(ann.TABLES):
        own = ann.bucket_ids(np.floor(index.places(x.astype(float), t, False)))
        size = dict(zip(*(z.tolist() for z in np.unique(own, return_counts=True))))
        for place in index.places(x[::100].astype(float), t, True):
            slots, _ = ann.probe_slots(place, index.width, index.radius, index.reach)
            scored += sum(size.get(b, 0) for b in ann.bucket_ids(np.array(slots)).tolist())
    print("scored share", scored / 40 / 4000, "k", index.a.shape[2], "reach", index.reach)
    assert scored / 40 / 4000 < 0.1


def test_probe_order_is_by_success():
    place = np.array([0.1, 5.55, -2.3])
    slots, sums = ann.probe_slots(place, 1.0, 0.5, 0.999)
    p = np.diff([0.0, *sums])
    assert len({tuple(s) for s in slots}) == len(slots) and (np.diff(p) <= 1e-12).all() and sums[-1] >= 0.999


def test_html_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Home</a></nav><div class='ad'>Buy</div>"
        "<article><h1>Head&amp;line</h1><p>One  <b>two</b>\n three<p>Four<br>five<script>if (a < b) {'</p>'}</script><aside>no</aside>"
        "<div class='comments'><p>a reader</p></div></article><form>f</form><footer>&copy;</footer>"
    )
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", None), (3, None, ""), (4, "x", "plain &lt;text&gt;"), (5, "http://a.example/5", "<p>unclosed <i>one<p>two</td></div>"), (1, "http://a.example/1", page)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, noise string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    main = "Head&line\nOne two three\nFour five"
    assert got == sorted([(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0), (4, "plain <text>", 12), (5, "unclosed one\ntwo", 16)])


def test_style_tree_drops_what_a_site_repeats(spark):
    rng = random.Random(10)
    page = lambda: f"<body><div class='x1'>Welcome to our site, dear guest</div><div class='x2'><p>{words(rng, 30)}</p></div></body>"
    rows = [(i, f"http://s.example/{i}", page()) for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Welcome" not in r["text"] and len(r["text"]) > 50 for r in got)


def test_html_article_survives_copies_and_telling_classes(spark):
    rng = random.Random(14)
    same = f"<body><nav>Home</nav><article class='post sidebar-layout'><h1>Title</h1><p>{words(rng, 30)}</p><div class='share-price'>The share price</div><section class='related-work'><p>Related work</p></section><div class='comments'>me too</div></article></body>"
    rows = [(i, f"http://c.example/{i}", same) for i in range(12)] + [(20 + i, f"http://c.example/{20 + i}", same.replace("Title", f"T{i}")) for i in range(12)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 24 and all("The share price\nRelated work" in r["text"] and len(r["text"]) > 60 and "me too" not in r["text"] and "Home" not in r["text"] for r in got)


def test_html_importance_equals_brute_force(spark):
    rng = random.Random(15)

    def page(i):
        cells = "".join(f"<li>{rng.choice(['Home', 'News', words(rng, 1)])}</li>" for _ in range(rng.randint(1, 4)))
        return f"<body><div class='a'>Welcome</div><div class='b'><ul>{cells}</ul></div><div class='c'>{words(rng, 9)}<p>{words(rng, 5)}</p></div></body>"

    pages = [page(i) for i in range(12)]
    want = brute.style_tree(pages, html_text)
    df = spark.createDataFrame([("h", i.to_bytes(2, "big"), p) for i, p in enumerate(pages)], "host string, page binary, html string")
    got = {r["node"]: r["importance"] for r in html_text.importance(html_text.page_features(df)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_html_tree_alone_and_without_it(spark):
    """Pages without an article or a telling class: what the style tree itself cuts (an ablation)."""
    rng = random.Random(16)
    body = [words(rng, 40) for _ in range(40)]
    page = lambda i: f"<body><div class='q1'>About us, legal and contact</div><div class='q2'><div>Sign up now</div></div><div class='q3'><p>{body[i]}</p></div><div class='q4'>All rights reserved</div></body>"
    rows = [(i, f"http://t.example/{i}", page(i)) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == body[i] for i in range(40))
    alone = ["\n".join(html_text.blocks(html_text.parse(page(i)), frozenset())) for i in range(40)]
    assert all(t == f"About us, legal and contact\nSign up now\n{body[i]}\nAll rights reserved" for i, t in enumerate(alone))


def test_html_pages_are_not_shuffled_to_their_noise(spark, monkeypatch):
    """However much noise there is: it goes to the pages; past MAX_SENT only open pages' pieces move."""
    rng = random.Random(18)

    def page(i):
        main = f"<article><p>{words(rng, 20)}</p><div class='k1'>About us</div></article>" if i % 3 == 0 else f"<div class='k3'>a &amp; <i>b</i>{words(rng, 20)}<p>x<br>y</div>"
        return f"<body><div class='k1'>About us</div>{main}<div class='k2'><div>All rights</div> reserved</div><script>s</script></body>"

    rows = [(i, f"http://n{i % 2}.example/{i}", page(i)) for i in range(60)] + [(i, None, None) for i in range(3)]
    rows += [(70, "http://n0.example/70", rows[1][2])] * 9
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    took = lambda d: sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in d.collect())
    monkeypatch.setattr(html_text, "MIN_PAGES", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = html_text.extract(df)
        assert "Exchange" not in plan(sent)
        monkeypatch.setattr(html_text, "MAX_SENT", 0)
        moved = html_text.extract(df)
        assert "Exchange" in plan(moved) and took(sent) == took(moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(took(sent)) == 72
    for i, _, text, n in took(sent):
        assert n == len(text) and ("About us" in text) == (text != "" and i < 60 and i % 3 == 0) and "All rights" not in text and "s" != text
        assert i % 3 == 0 or i == 70 or text == "" or (text.startswith("a & b") and text.endswith("\nx y"))


def test_html_very_long_and_deep_page(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {i} of it</p>" for i in range(20000)) + "</article>"
    deep = "<body>" + "<div>" * 3000 + "<p>down here</p>" + "</div>" * 3000
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([(1, "u", long), (2, "u", deep)], "page_id long, url string, html string")).collect()}
    assert got[1].count("\n") == 19999 and got[2] == "down here"


def test_language_id(spark):
    rng = random.Random(11)
    vocab = {"en": "the of and to in is that for it was on with".split(), "de": "der die und in den von zu das mit sich des auf".split(), "fr": "le la les et des en un du une que est pour".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(3, 40))), lang) for i in range(150) for lang in [rng.choice(list(vocab))]]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (904, "½ ² ①", None), (903, "der und die mit", None)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    right = [got[i]["lang_pred"] == lang for i, t, lang in rows[:150] if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.9
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902, 904)) and got[903]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_forward_sums_all_segmentations():
    from itertools import product

    table = langid.lookup()
    vocab = langid.pieces()
    rng = np.random.default_rng(0)
    prob = rng.random((len(vocab) + 1, 2)) * 0.1

    def brute_force(w):
        total = np.zeros(2)
        for cuts in product([0, 1], repeat=len(w) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            p = np.ones(2)
            for a, b in zip(at, at[1:]):
                piece = w[a:b]
                p = p * (prob[vocab[piece]] if piece in vocab else prob[-1] if b - a == 1 else 0)
            total += p
        return np.log(total)

    items = ["▁the", "▁und", "▁ñandú", "xyz", "▁information", "▁importants"]
    assert "▁information" in vocab
    assert np.allclose(langid.score_parts(items, table, prob), [brute_force(w) for w in items])
    # a word of many unknown characters keeps its own score in each language
    assert np.allclose(langid.score_parts(["ꙮ" * 200], table, prob), 200 * np.log(prob[-1]))
    assert langid.letter_runs("½²") == [] and langid.letter_runs("a²b") == ["a", "b"] and langid.letter_runs("don't") == ["don", "t"]
    many = langid.expected_uses(["▁information" * 40], np.array([1]), np.array([1]), table, prob)
    assert np.isfinite(many).all() and many[:, 1].sum() > 40
    uses = langid.expected_uses(["▁the"], np.array([0]), np.array([3]), table, prob)
    assert uses[:, 1].sum() == 0 and uses[:, 0].sum() > 0


def test_language_id_equals_brute_force(spark):
    """Predictions over whole texts are the greatest of prior plus the sum of all words' scores."""
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()), max_docs=10**9)
    langs, prob, prior = model
    got = {r["doc_id"]: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    table, memo = langid.lookup(), {}
    right = []
    for r in docs.collect():
        runs = [w for t in (r["text"] or "").split() for w in langid.letter_runs(t.lower())]
        if not runs:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        new = sorted(set(runs).difference(memo))
        memo.update(zip(new, langid.score_parts(["▁" + w for w in new], table, prob) if new else []))
        total = prior + sum(memo[w] for w in runs)
        assert got[r["doc_id"]]["lang_pred"] == langs[int(np.argmax(total))]
        if r["lang"]:
            right.append(got[r["doc_id"]]["lang_pred"] == r["lang"])
    assert np.mean(right) > 0.97


def test_language_sample_has_a_floor(spark):
    rows = [(i, f"the of and {i}", "en") for i in range(400)] + [(1000 + i, f"og det som {i}", "da") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prob, _ = langid.train(df, max_docs=4, floor_docs=20)
    piece = langid.pieces()["▁det"] if "▁det" in langid.pieces() else langid.pieces()["▁som"]
    assert langs == ["da", "en"] and prob[piece, 0] > 10 * prob[piece, 1]


def test_quality(spark):
    rng = random.Random(12)
    good = [(i, words(rng, rng.randint(30, 120)).capitalize() + ".") for i in range(200)]
    bad = [(1000 + i, " ".join(w + rng.choice(["%%%", "***", "$$$", "###"]) for w in words(rng, 60).split())) for i in range(12)]
    bad += [(1100 + i, words(rng, 60).upper().replace(" ", "!! ")) for i in range(12)]
    rows = good + bad + [(2000, None), (2001, ""), (2002, "  ")]
    got = {r["doc_id"]: r["keep"] for r in quality.classify(frame(spark, rows)).collect()}
    assert sum(got[i] for i, _ in good) >= 198 and sum(got[i] for i, _ in bad) <= 1
    assert not any(got[i] for i in (2000, 2001, 2002))


def test_quality_equals_brute_force_and_labels(spark):
    """The query's scores are those of a plain run of the same steps, and tell labelled rows apart."""
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    votes = {i: tuple(quality.votes_of(quality.statistics(t))) for i, t in texts.items()}
    patterns = sorted(set(votes.values()))
    post = dict(zip(patterns, quality.label_model(np.array(patterns), np.array([list(votes.values()).count(p) for p in patterns], float))))
    w = quality.fit([quality.features(t) for t in texts.values()], np.array([post[votes[i]] for i in texts]))
    want = {}
    for i, t in texts.items():
        ids, vals = quality.features(t)
        want[i] = 1 / (1 + np.exp(-(w[ids] @ vals + w[-1]))) if t.strip() else 0.0
    got = {r["doc_id"]: r["quality_score"] for r in quality.op6_quality(spark, root).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in got)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    good, bad = [got[i] for i in got if label.get(i) == 1], [got[i] for i in got if label.get(i) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and np.mean([g >= quality.THRESHOLD for g in good]) > 0.98


def test_quality_repeats_and_clashing_columns(spark):
    rng = random.Random(40)
    rows = [(i, words(rng, 60).capitalize() + ".") for i in range(30)] + [(90, "%% $$ ## " * 30)] * 3 + [(None, "A b.")]
    df = frame(spark, rows).selectExpr("*", "1 as keep", "'x' as quality_score")
    got = quality.classify(df).collect()
    assert len(got) == 34 and len({r["quality_score"] for r in got if r["doc_id"] == 90}) == 1 and not any(r["keep"] for r in got if r["doc_id"] == 90)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20000) < 0.8
    votes = np.stack([np.where(rng.random(20000) < 0.3, -1, np.where(rng.random(20000) < acc, y, ~y)) for acc in (0.9, 0.8, 0.85, 0.95)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post = quality.label_model(patterns, counts.astype(float))
    by = {tuple(p): x for p, x in zip(patterns.tolist(), post)}
    assert np.mean((np.array([by[tuple(v)] for v in votes.tolist()]) > 0.5) == y) > 0.93


def test_mixing_fills_siblings_first(spark):
    # language en of d0 is short; de, its sibling, takes what is left of the domain's budget
    rows = [(i, "w " * 10, "en", "src0") for i in range(2)] + [(10 + i, "w " * 10, "de", "src3") for i in range(50)] + [(100 + i, "w " * 10, "en", "src1") for i in range(50)]
    rows += [(900, None, None, None), (901, "", "en", "src0")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, domain string, epoch int")
    out = mixing.mix(df, budget_share=0.5, max_epochs=1, domain_weights={}, lang_weights={})
    got = {(r["domain"], r["lang"]): r["n"] for r in out.groupBy("domain", "lang").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert got[("d0", "en")] == 20 and got[("d0", "de")] == 240 and got[("d1", "en")] == 260
    assert mixing.mix(df.where("false")).count() == 0


@pytest.mark.parametrize("f", [suffix_dedup.remove_repeats, substring_dedup.remove_repeats, line_dedup.dedup_lines, simhash.near_duplicates, quality.classify, langid.identify])
def test_empty_table(spark, f):
    assert f(frame(spark, [(1, "x")]).where("false")).count() == 0


def test_empty_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(df).count() == 0


def test_queries_are_registered():
    from sondera.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(13)
    items = [(i, words(rng, 25).capitalize() + ". " + words(rng, 9).capitalize() + ".") for i in range(5)]
    rows = [(i, "\n".join(words(rng, 25).capitalize() + "." for _ in range(4))) for i in range(60)]
    rows[7] = (7, rows[6][1])
    rows[9] = (9, rows[9][1] + "\n" + items[2][1])
    rows += [(200 + i, " ".join(w + rng.choice(["%%%", "***", "$$$"]) for w in words(rng, 60).split())) for i in range(6)] + [(300, None), (301, "")]
    frame(spark, rows).select(*P.COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    after = {}
    for name, f in P.STAGES:
        docs = f(spark, docs, f"file://{tmp_path}").cache()
        after[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = set(range(60))
    assert after["quality classifier"] == clean
    assert after["line dedup"] == clean - {7}
    assert after["simhash near-dedup"] == clean - {7}
    assert after["benchmark decontamination"] == clean - {7, 9}
    assert set(docs.columns) >= set(P.COLUMNS)
    assert set(P.run(spark, f"file://{tmp_path}").columns) >= set(P.COLUMNS)


def test_pipeline_stages_tell_rows_apart(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(29)
    leak = words(rng, 25).capitalize() + ". " + words(rng, 9).capitalize() + "."
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(None, a), (None, b + " " + leak), (7, b), (7, leak), (7, c), (8, None), (8, "")]
    got = P.drop_leaks(spark, frame(spark, rows), f"file://{tmp_path}").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in [(None, a), (7, b), (7, c), (8, None), (8, "")])
    # as many rows as the mix takes, also with repeated rows and ids
    rows = [(7, a), (7, a), (7, b), (None, a), (None, c), (5, None)] + [(10 + i, words(rng, 20)) for i in range(10)]
    docs = frame(spark, rows)
    mixed = P.mix_sources(spark, docs, "")
    assert mixed.count() == mixing.mix(P._keyed(docs), id_col="row").count()
    empty = docs.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0


def test_pipeline_near_copies_of_similarity_08(spark):
    import corpus_pipeline as P

    rng = random.Random(17)
    rows = []
    for i in range(30):
        w = words(rng, 200).split()
        rows.append((2 * i, " ".join(w)))
        for at in rng.sample(range(0, 200, 20), 1 + i % 6):
            w[at] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    similar = [len(a & b) / len(a | b) >= 0.8 for a, b in zip(grams[::2], grams[1::2])]
    far = [bin(brute.simhash(a[1]) ^ brute.simhash(b[1])).count("1") > 4 for a, b in zip(rows[::2], rows[1::2])]
    assert True in similar and False in similar and any(s and f for s, f in zip(similar, far))
    kept = {r["doc_id"] for r in P.one_of_near_duplicates(spark, frame(spark, rows), "").collect()}
    assert kept == set(range(60)) - {2 * i + 1 for i, s in enumerate(similar) if s}


def test_pipeline_near_copies_chain_within_a_band(spark):
    """Components are those of all similar pairs, also where rows are near each other but not near the least."""
    rng = random.Random(5)
    w = words(rng, 300).split()
    rows = []
    for i in range(8):
        rows.append((i, " ".join(w)))
        for at in range(12 * i, 12 * i + 12, 6):
            w[at] += "x"
    rows += [(20 + i, words(rng, 50)) for i in range(3)]
    kept = {r["doc_id"] for r in near_copies.one_of_each(frame(spark, rows)).collect()}
    assert kept == {0, 20, 21, 22}
    assert near_copies.one_of_each(frame(spark, [])).count() == 0


def test_pipeline_near_copies_in_dense_groups(spark, monkeypatch):
    """Bands of many rows that are not all alike: blocks of them give the same groups as all pairs."""
    monkeypatch.setattr(near_copies, "MEMBERS", 3)
    monkeypatch.setattr(near_copies, "CELL", 5)
    rng = random.Random(41)
    w = words(rng, 240).split()
    rows = []
    for i in range(36):
        v = list(w)
        for at in rng.sample(range(0, 240, 6), rng.randint(1, 5)):
            v[at] = rng.choice(["one", "two"])
        rows.append((i, " ".join(v)))
    sets = [near_copies.shingles(t) for _, t in rows]
    parent = list(range(36))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(36):
        for b in range(a):
            if near_copies.similarity(sets[a], sets[b]) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    kept = {r["doc_id"] for r in near_copies.one_of_each(frame(spark, rows)).collect()}
    assert 1 < len(kept) < 36 and kept == {root(i) for i in range(36)}


def test_pipeline_near_copies_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    rng = random.Random(23)
    a, b, c, d, e = (words(rng, 80) for _ in range(5))
    near = d + " end"
    rows = [(None, a), (None, b), (None, b), (4, c), (4, d), (3, near), (5, None), (None, ""), (6, e), (6, e)]
    got = P.one_of_near_duplicates(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, a), (None, b), (4, c), (3, near), (5, None), (6, e)]))


def test_ann_probes_are_never_sent_whole_through_the_driver(spark, monkeypatch):
    """Few queries probe many buckets: the join must not be planned by the queries' own small size."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plans, real = [], ann._best
    monkeypatch.setattr(ann, "_best", lambda pairs, *a: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or real(pairs, *a))
    got = ann.neighbours(rows, rows.where("vec_id % 20 = 0"), top=150).groupBy("query_id").count().collect()
    assert len(got) == 10 and all(r["count"] == 150 for r in got)
    assert plans and not any(re.search(r"(BroadcastHashJoin|BroadcastNestedLoopJoin)[^\n]*Inner", p) for p in plans)


def test_ann_sample_of_least_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "SAMPLE_ROWS", 64)
    rows = spark.range(3000).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    want = [r["v"] for r in rows.orderBy(F.xxhash64("v"), "v").limit(64).collect()]
    for size in (3000, 1, 10**9):  # a wrong size costs a second look, no rows
        assert [r["v"] for r in ann._least_hashes(rows, size)] == want


def test_pipeline_near_copies_go_through_simhash(spark, monkeypatch):
    """The stage links fingerprints of four differing bits at most, over all texts, before anything else."""
    import corpus_pipeline as P

    rng = random.Random(61)
    rows = []
    for i in range(12):
        w = words(rng, 400).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1] + ["other"]))]
    prints = [brute.simhash(t) for _, t in rows]
    near = {(min(a, b), max(a, b)) for a, b in zip(prints[::2], prints[1::2]) if 0 < (a ^ b).bit_count() <= 4}
    seen, linked, real = set(), set(), near_copies.links

    def links(df, *a):
        seen.update(r["fp"] % 2**64 for r in df.collect())
        out = real(df, *a)
        linked.update(tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in out.collect())
        return out

    monkeypatch.setattr(near_copies, "links", links)
    kept = {r["doc_id"] for r in P.one_of_near_duplicates(spark, frame(spark, rows), "").collect()}
    assert near and seen == set(prints) and linked >= near
    assert kept == set(range(0, 24, 2))
