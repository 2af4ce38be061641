"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillwork.llm import common, line_dedup, lm_score, mixing, registry, sentencepiece_bpe, simhash_dedup, spotsigs, toxicity, url_filter
from quillwork.llm.shingles import batches, shingle_sets, word_hashes

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    """Smallest id of each document's component under a similarity of 0.8 or more, from all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in texts}


def near_corpus(seed=0, groups=25, copies=6):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, shared = {}, " ".join(rng.choices(vocabulary, k=12))
    for _ in range(groups):
        base = [*shared.split(), *rng.choices(vocabulary, k=rng.randint(60, 200))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(w)
    return texts


@pytest.mark.parametrize("group", [2048, 8])
def test_near_classes(spark, group, monkeypatch):
    monkeypatch.setattr(simhash_dedup._placed, "__defaults__", (group,))
    texts = near_corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in simhash_dedup.near_classes(df).collect()}
    assert got == classes(texts)


def test_near_copies_in_a_hot_passage(spark, monkeypatch):
    """Pairs of near copies with a passage, 0.7 of their shingles, that far more nodes share than a key may have."""
    monkeypatch.setattr(simhash_dedup._placed, "__defaults__", (16,))
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = words(80), {}
    for i in range(0, 120, 2):
        tail = words(29)
        texts[i], texts[i + 1] = " ".join(passage + tail), " ".join(passage + tail[:-10] + words(10))
    for i in range(120, 400):
        texts[i] = " ".join(passage + words(29))
    want = classes(texts)
    assert all(want[i + 1] == i for i in range(0, 120, 2)) and len(set(want.values())) == 340
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in simhash_dedup.near_classes(df).collect()} == want


def test_near_classes_of_documents(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall())
    got = {r.doc_id: r.class_id for r in registry.QUERIES["op1_simhash_near_dedup"](spark, SMALL).collect()}
    assert got == classes(texts)


def test_thousand_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = [(i, " ".join(base[: i % 150] + [f"z{i}"] + base[i % 150 :])) for i in range(1500)] + [(5000 + i, f"all other words stand here {i} " * 9) for i in range(5)]
    got = {r.doc_id: r.class_id for r in simhash_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(1500)} == {0}


def _shuffled(spark):
    """Bytes that were written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_few_texts_are_shuffled(spark):
    """Texts without a near copy stay where they are, when sets are made anew and when copies are dropped."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(2000)) for _ in range(200)]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(1000, texts[3] + " more"), (1001, texts[9] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table that is too large for it
    try:
        before = _shuffled(spark)
        got = sorted(simhash_dedup.without_near_copies(df).collect(), key=str)
        assert _shuffled(spark) - before < 0.5 * sum(map(len, texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([r for r in rows if r[0] not in (None, 1000)], key=str)


def test_small_world_finds_neighbours():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, (600, 2)).astype(np.uint64)
    codes[1::2] = codes[::2] ^ np.uint64(0b1011)
    a, b = simhash_dedup.nearest(codes)
    assert set(zip(a.tolist(), b.tolist())) >= {(i, i ^ 1) for i in range(600)}
    world = simhash_dedup.SmallWorld(codes)
    ids, far = world.search(np.arange(50), 24)
    assert (np.diff(far, axis=1) >= 0).all() and not (ids == np.arange(50)[:, None]).any()


def test_simhash_bits():
    h = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(3)
    start = np.array([0, 0, 1, 300, 1000])
    got = simhash_dedup.simhash(h, start)
    for k in range(4):
        part = h[start[k] : start[k + 1]]
        want = sum(1 << b for b in range(64) if 2 * sum((int(x) >> b) & 1 for x in part) > len(part))
        assert int(got[k]) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é_.\n", max_size=30), max_size=5))
def test_shingles_of_any_texts(texts):
    for _, part in batches(texts):
        h, start = shingle_sets(part)
        words, count = word_hashes(part)
        plain = [re.findall(r"[a-z0-9_\x80-\U0010ffff]+", b.decode()) for b in part]
        assert count.tolist() == [len(w) for w in plain]
        assert np.diff(start).tolist() == [len(shingles(b.decode())) for b in part]
        flat = [w for p in plain for w in p]
        assert len(set(words.tolist())) == len(set(flat))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, pairs):
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {i: i for p in pairs for i in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_exact_and_url_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{MIDDLE}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        got, want = registry.QUERIES[name](spark, MIDDLE).toPandas(), con.sql(sql).df()
        key = want.columns[0]
        a, b = (x[sorted(want.columns)].sort_values(key).astype(str).reset_index(drop=True) for x in (got, want))
        missing = ["None", "<NA>"]  # how a missing value is told depends on the column's type alone
        pd.testing.assert_frame_equal(a.replace(missing, "nan"), b.replace(missing, "nan"))


def test_rules_of_a_table(spark):
    """A table of rules judges as the list does."""
    pages = spark.read.parquet(f"{MIDDLE}/pages.parquet")
    odd = [(-1, "http://A.ORG", None), (-2, None, None), (-3, "no scheme", ""), (-4, "https://x.example.org/es/?q#f", None), (-5, "http://com/de/1", None), (-6, "http://.org/", None)]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema))
    rules = [*url_filter.RULES, ("block", "org", "/"), ("block", "example.org", "/es/1")]
    table = spark.createDataFrame([*rules, (None, "x", "/")], "action string, host string, path string")
    a, b = (url_filter.filter_urls(pages, r).orderBy("page_id").collect() for r in (rules, table))
    assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_redirects(spark):
    pages = [
        (1, "http://a.net/x", '<link rel="canonical" href="https://example.org/es/1">'), (2, "http://b.net/y", '<meta http-equiv="refresh" content="0; url=http://a.net/x#f">'),
        (3, "http://c.net/y", "<LINK href='/z' REL='canonical'>"), (4, "http://c.net/z", "<link rel=canonical href=http://d.com/de/1>"),
        (5, "http://c.net/q", '<link rel="canonical" href="http://q.com/fr/1?a=1&amp;b=2">'), (6, "http://e.net/p", '<link rel=canonical href="http://c.net/q"><link rel="canonical" href="http://d.com/de/9">'),
        (7, "http://f.net/", '<link rel="stylesheet" href="http://d.com/de/9">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [r.verdict for r in url_filter.filter_urls(df).orderBy("page_id").collect()] == ["block"] * 4 + ["allow"] * 3
    edges = spark.createDataFrame([("http://f.net/", "http://b.net/y")], "src string, dst string")
    assert url_filter.filter_urls(df, edges=edges).where("page_id = 7").first().verdict == "block"


def test_mix_keeps_targets(spark):
    rows = registry.QUERIES["op4_mix_sources"](spark, MIDDLE).toPandas()
    source = duckdb.sql(f"select doc_id, source from '{MIDDLE}/documents.parquet'").df()
    t = rows.merge(source, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(t.taken - t.target) <= 1).all() and abs(t.target.sum() - rows["size"].sum()) < 1e-6
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixing.mixed(docs).select("text").collect())
    assert words == rows.taken.sum()


@settings(max_examples=80, deadline=None)
@given(st.text("ab e\n▁é😀.,'1", max_size=60))
def test_pieces_round_trip(text):
    e = sentencepiece_bpe.encoder_of(sentencepiece_bpe.MODEL, 1, 0.3)
    for v in range(sentencepiece_bpe.VARIANTS):
        assert e.p.decode(e.encode([text], [v])[0]) == text


def test_pieces_without_dropout():
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    texts = [t for (t,) in duckdb.sql(f"select text from '{SMALL}/documents.parquet'").fetchall()] + ["a  b", " x ", "\t\n", "w" * 300]
    got = sentencepiece_bpe.Encoder(dropout=0.0).encode(texts, [0] * len(texts))
    assert [x.tolist() for x in got] == sp.encode(texts)


def test_dropout_varies_and_repeats():
    texts = [t for (t,) in duckdb.sql(f"select text from '{SMALL}/documents.parquet' limit 20").fetchall()]
    a, b = (sentencepiece_bpe.Encoder(seed=s).encode(texts, [0] * 20) for s in (1, 1))
    c = sentencepiece_bpe.Encoder(seed=2).encode(texts, [0] * 20)
    assert all((x == y).all() for x, y in zip(a, b)) and any(len(x) != len(y) or (x != y).any() for x, y in zip(a, c))
    p = sentencepiece_bpe.pieces()
    words = sorted({w for t in texts for w in p.word.findall(" " + t)})[:500]
    keys = [sentencepiece_bpe.word_key(w, 7, 0) for w in words]
    short = [w for w in words if len(w) <= sentencepiece_bpe.LONG]
    side_by_side = sentencepiece_bpe.together(p, short, [sentencepiece_bpe.word_key(w, 7, 0) for w in short], 0.2)
    heap = {w: sentencepiece_bpe.agenda(p, w, k, 0.2) for w, k in zip(words, keys)}
    assert all(np.frombuffer(x, np.int32).tolist() == heap[w] for w, x in zip(short, side_by_side))


def spots(text):
    out, content, waiting = set(), [], ("",)
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        if w in spotsigs.COMMON:
            waiting += (w,)
        else:
            content.append((waiting, w))
            waiting = ()
    if waiting and waiting != ("",):
        content.append((waiting, ""))
    return {(p, *(c for _, c in content[i : i + 3])) for i, (p, _) in enumerate(content) if p}


def test_spotsigs(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall())
    order = sorted(texts, reverse=True)
    next_ = dict(zip(order, order[1:] + order[:1]))

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in registry.QUERIES["op7_spotsigs"](spark, SMALL).collect():
        t, u = texts[r.doc_id], texts[next_[r.doc_id]]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(spots(t), spots(edited)), abs=1e-6) and r.near_next == pytest.approx(alike(spots(t), spots(u)), abs=1e-6)


def test_similar_fingerprints(spark):
    texts = near_corpus(1)
    texts = {i: re.sub(r"(\S+ \S+ \S+) ", r"\1 the ", t) for i, t in texts.items()}
    first = {}
    for i in sorted(texts):
        first.setdefault(frozenset(spots(texts[i])), i)
    names = {i: s for s, i in first.items()}
    want = {(a, b) for a in names for b in names if a < b and len(names[a] & names[b]) >= 0.8 * len(names[a] | names[b])}
    got = spotsigs.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r.a, r.b) for r in got} == want and want


def test_pattern_of_anchors():
    """The pattern is of the common words alone, and tries no first letter twice."""
    near = {w[:k] for w in spotsigs.COMMON for k in range(len(w))} | {w + c for w in spotsigs.COMMON for c in "aest"}
    found = {w for w in near | set(spotsigs.COMMON) if re.search(spotsigs._ANCHOR, f" {w} ")}
    assert found == set(spotsigs.COMMON)
    depth, first = 0, []
    for c, after in zip(spotsigs._ANCHOR[len("(?<= )(") :], spotsigs._ANCHOR[len("(?<= )(") + 1 :]):
        depth += (c == "(") - (c == ")")
        if c in "|:" and depth < 2:
            first.append(after)
    assert len(first) == len(set(first)) == len({w[0] for w in spotsigs.COMMON})


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from here into the deep dark wood again".split()
    rows = [(0, " ".join(base)), (1, "Other line.\n" + " ".join(base).upper() + "!"), (2, "other  line\nwholly different words stand in this one here"), (3, "wholly different words stand in this one here\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in line_dedup.fuzzy_lines(df).collect()}
    assert got == {0: [], 1: [1], 2: [0], 3: [0]}
    assert [r.text for r in line_dedup.without_repeated_lines(df).orderBy("doc_id").collect()][1:] == ["Other line.", rows[2][1].split("\n")[1], "\n"]


def similar_lines(lines):
    """All pairs of lines whose edit distance is at most a fifth of the longer one's length, by brute force."""
    chars = {c: k for k, c in enumerate(sorted(set("".join(lines))))}
    single = ["".join(chr(33 + chars[c]) for c in x) for x in lines]  # one byte a character, as the distance counts bytes
    assert len(chars) < 94
    size = np.array([len(x) for x in lines])
    count = np.array([np.bincount([chars[c] for c in x], minlength=len(chars)) for x in lines])
    pairs = []
    for k in range(len(lines)):
        # no edit mends more than one surplus character of either side
        more = np.clip(count[:k] - count[k], 0, None).sum(1), np.clip(count[k] - count[:k], 0, None).sum(1)
        pairs += [(int(j), k) for j in np.flatnonzero(np.maximum(*more) <= np.round(0.2 * np.maximum(size[:k], size[k]), 9))]
    df = pd.DataFrame({"a": [single[a] for a, _ in pairs], "b": [single[b] for _, b in pairs]})
    far = duckdb.sql("select levenshtein(a, b) as d from df").df()["d"]
    return {(a, b) for (a, b), d in zip(pairs, far) if d <= round(0.2 * max(size[a], size[b]), 9)}


def _groups(lines, pairs):
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(lines[a])] = find(lines[b])
    return {x: find(x) for x in lines}


def test_lines_of_documents(spark):
    """Against all pairs of distinct lines by edit similarity alone: nothing else is dropped, and at least 97 % of the links are found."""
    texts = dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet' union all select doc_id + 1000000, text from '{MIDDLE}/documents.parquet' where doc_id < 300").fetchall())
    seen = []
    for i in sorted(texts):
        for at, line in enumerate(texts[i].split("\n")):
            n = " ".join(re.findall(r"[^\W_]+", line.lower()))
            if n:
                seen.append((i, at, n))
    lines = sorted({n for *_, n in seen})
    pairs = similar_lines(lines)
    group = _groups(lines, pairs)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    dropped = {(r.doc_id, at) for r in line_dedup.fuzzy_lines(df).collect() for at in r.dropped}
    kept = {}
    for i, at, n in seen:
        if (i, at) not in dropped:
            kept.setdefault(group[n], []).append((i, at))
    assert all(group[n] in kept for i, at, n in seen)  # each group keeps one
    want = len(seen) - len(set(group.values()))
    equal = len(seen) - len(lines)
    assert equal + 0.97 * (want - equal) <= len(dropped) <= want and want > equal + 20


def test_pieces_of_an_arrow_batch(monkeypatch):
    """Texts of an Arrow batch become Python's a few at a time, and the pieces of the result are the batch again."""
    monkeypatch.setattr(sentencepiece_bpe, "AT_ONCE", 50)
    texts = ["a word and another one " * 3, None, "", "short", "\u2581 z\U0001f600", "x" * 200, None, "the end"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(8), pa.int64()), "text": texts, "variant": pa.array([0, 1, 2, 3] * 2, pa.int32())})
    parts = list(sentencepiece_bpe.encoded(sentencepiece_bpe.MODEL, 42, 0.1)(iter([batch])))
    assert len(parts) > 2
    rows = pa.Table.from_batches(parts).to_pylist()
    want = sentencepiece_bpe.Encoder().encode(texts, [0, 1, 2, 3] * 2)
    assert [r["ids"] for r in rows] == [None if x is None else x.tolist() for x in want]
    assert [r["n_pieces"] for r in rows] == [None if x is None else len(x) for x in want] and [r["doc_id"] for r in rows] == list(range(8))
    assert [r["decoded_crc32"] for r in rows] == [None if t is None else zlib.crc32(t.encode()) for t in texts]


def test_remembered_segmentations(monkeypatch):
    """What a worker remembers is bounded, that of earlier texts too; what it has forgotten comes out the same again."""
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 400)
    encoder = sentencepiece_bpe.Encoder()
    texts = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(30)]
    first = [encoder.encode([t], [0])[0].tolist() for t in texts]
    for t, ids in zip(texts, first):
        assert encoder.encode([t], [0])[0].tolist() == ids
        assert sum(map(len, encoder.known)) + sum(map(len, encoder.older)) <= 400 // sentencepiece_bpe.VARIANTS


def test_links_without_a_shared_block(spark):
    """Similar lines that share no run of words, or have no block at all, are linked."""
    rng = random.Random(5)
    rows = [(0, "hello world"), (1, "hello worls"), (2, "abcde"), (3, "abcdf"), (4, "abcd"), (5, "abce")]
    for k in range(6):
        line = " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(40))
        # one character of each word is another one: a seventh of the line
        other = " ".join(w[:2] + "z" + w[3:] for w in line.split())
        rows += [(10 + 2 * k, line), (11 + 2 * k, other)]
    script = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))  # no spaces
    rows += [(30, script), (31, script[:30] + "x" + script[31:])]
    pairs = _all_pairs([t for _, t in rows])
    assert len(pairs) == 12
    lost = {rows[b][0] for _, b in pairs}
    got = {r.doc_id: r.n_kept for r in line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i not in lost) for i, _ in rows}


def test_files_of_all_pairs(spark, monkeypatch):
    """The comparison of all lines writes each once, whatever it meets."""
    rng = random.Random(11)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(100, 120)))) for i in range(1500)]
    folder = common.shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    rest, grown = line_dedup._rest, []

    def measured(*args):
        before = size()
        out = rest(*args)
        out.count()
        grown.append(size() - before)
        return out

    monkeypatch.setattr(line_dedup, "_rest", measured)
    assert line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_kept = 1").count() == 1500
    assert 0 < grown[0] < 3 * sum(len(t) for _, t in rows)


def test_bounds_of_all_pairs(spark, monkeypatch):
    """However the edits lie, and in whichever round, a pair at exactly the similarity is found and one beyond it is not."""
    monkeypatch.setattr(line_dedup, "AT_ONCE", 900)
    rng = random.Random(7)
    rows = []
    for k in range(24):
        n = rng.choice([10, 40, 75, 150, 400])
        base = [rng.choice("aeint" if k % 3 else "abcdefghijklmnopqrstuvwxyzé") for _ in range(n)]
        # a letter for another, all at the begin, all at the end or anywhere; or the end is cut off
        at = [range(n // 5), range(n - n // 5, n), rng.sample(range(n), n // 5), ()][k % 4]
        other = [rng.choice("QWXZ").lower() if i in at else c for i, c in enumerate(base)] if at else base[n // 5 :]
        rows += [(2 * k, "".join(base)), (2 * k + 1, "".join(other))]
    rows += [(100, "e" * 30 + "x" * 9), (101, "e" * 30)]
    lost = {rows[b][0] for _, b in _all_pairs([t for _, t in rows])}
    assert 24 <= len(lost) < 48
    got = {r.doc_id: r.n_kept for r in line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i not in lost) for i, _ in rows}


def test_pieces_that_edits_leave(spark):
    """No pair within the distance has fewer common pieces than the bound asks for, wherever the edits lie; unlike lines have."""
    rng = random.Random(19)
    rows = []
    for k in range(150):
        n = rng.choice([3, 10, 40, 120, 300])
        x = rng.choices("abcdefghij klm" if k % 2 else "ab", k=n)
        y, at = list(x), (0, n, rng.randrange(n))[k % 3]
        for e in range(n // 5):
            i = min(max(at, 0), len(y)) if k % 5 else rng.randrange(len(y) + 1)
            if e % 2 and k % 4:
                y.insert(i if k % 7 else len(y) - i, rng.choice("xyz"))
            elif k % 8 < 4:
                y[i : i + 1] = "x" if i < len(y) else ""
            else:
                del y[min(i, len(y) - 1)]
        x, y = sorted(("".join(x), "".join(y)), key=len, reverse=True)
        rows.append((x, y, _distance(x, y), len(x) // 5))
    near = [r for r in rows if r[2] <= r[3]]
    assert len(near) > 100
    far = [("".join(rng.choices("abcdefghij klm", k=150)), "".join(rng.choices("abcdefghij klm", k=140)), 0, 30) for _ in range(20)]
    for wide in (4, 9, 40):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(near + far)], "id int, x string, y string, d int, most int")
        df = df.select("id", line_dedup._pieces(F.col("x"), F.col("most"), wide).alias("p"), line_dedup._grams(F.col("y"), wide).alias("g"))
        left = {r.id for r in df.where(F.size(F.array_intersect("p.hashes", "g")) >= F.col("p.least")).select("id").collect()}
        assert left == set(range(len(near)))


def _all_pairs(lines):
    return {(a, b) for b in range(len(lines)) for a in range(b) if _distance(lines[a], lines[b]) <= round(0.2 * max(len(lines[a]), len(lines[b])), 9)}


@given(st.lists(st.sampled_from("a bb ccc dddd eeeee".split()), min_size=1, max_size=12), st.lists(st.sampled_from("a bb ccc dddd eeeee".split()), min_size=1, max_size=12))
@settings(max_examples=12, deadline=None)
def test_bound_of_distance(spark, a, b):
    x, y = " ".join(a), " ".join(b)
    (bound,) = spark.createDataFrame([(x, y)], "x string, y string").select(line_dedup._bound(F.col("x"), F.col("y"))).first()
    assert bound >= _distance(x, y) and (x != y or bound == 0)
    if len(a) == len(b):
        assert bound <= sum(max(len(u), len(v)) for u, v in zip(a, b) if u != v)


def test_lines_of_a_shared_block(spark):
    """Lines of one block in several groups: each group is found, however the first line of the block compares."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    shared, rows = [word() for _ in range(6)], []
    for g in range(5):
        base = [word() for _ in range(20)]
        for c in range(4):
            w = list(base)
            w[rng.randrange(20)] = word()
            rows.append((10 * g + c, " ".join(shared + w)))
    got = {r.doc_id: r.n_kept for r in line_dedup.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i % 10 == 0) for i, _ in rows}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_classes_recall(spark):
    """Every hundredth document against all of sf0.1: each text of a similarity of 0.8 or more is in its class."""
    path = "/root/testdata/sf0.1/documents.parquet"
    sets = {i: shingles(t) for i, t in duckdb.sql(f"select doc_id, text from '{path}'").fetchall()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    of = {r.doc_id: r.class_id for r in simhash_dedup.near_classes(spark.read.parquet(path)).collect()}
    links = found = 0
    for i in (i for i in sets if i % 100 == 0 and sets[i]):
        shared = Counter(j for x in sets[i] for j in where[x] if j != i)
        near = [j for j, n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
        links += len(near)
        found += sum(of[j] == of[i] for j in near)
    assert links > 20 and found >= 0.99 * links


def test_network_learns_contexts(spark):
    rng = random.Random(0)
    pairs = [(f"a{k}", f"b{k}", f"c{k}") for k in range(30)]
    rows = [(i, " ".join(" ".join(rng.choice(pairs)) for _ in range(100))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words, net = lm_score.fit(df)
    shuffled = [(i, " ".join(rng.sample(t.split(), 300))) for i, t in rows[:50]]
    ordered = lm_score.score(df.where("doc_id < 50"), words, net).agg(F.avg("per_word")).first()[0]
    mixed = lm_score.score(spark.createDataFrame(shuffled, df.schema), words, net).agg(F.avg("per_word")).first()[0]
    assert ordered > -np.log(90) + 0.3 > mixed


def _network(seed=0):
    rng = np.random.default_rng(seed)
    net = lm_score.Network.start(rng.integers(1, 100, lm_score.VOCABULARY).astype(float))
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    return net


def _plain_log(net, ids, count):
    """Word after word, document after document."""
    p, out, at = net.p, [], 0
    for n in count:
        doc = ids[at : at + n]
        for i in range(n):
            h = p["b"].copy()
            for k, w in enumerate(lm_score.WINDOW):
                x = doc[i + w] if 0 <= i + w < n else lm_score.VOCABULARY
                h += p["e"][k * (lm_score.VOCABULARY + 1) + x]
            h = np.tanh(h)
            a, b = divmod(doc[i], lm_score.BASE)
            one, two = h @ p["w1"] + p["b1"], h @ p["w2"] + p["u"][a]
            out.append(one[a] - np.log(np.exp(one).sum()) + two[b] - np.log(np.exp(two).sum()))
        at += n
    return np.array(out)


def test_network_against_plain_version():
    rng, net = np.random.default_rng(1), _network()
    count = np.array([1, 0, 2, 7, 30])
    ids = rng.integers(0, lm_score.VOCABULARY, count.sum())
    window = lm_score.windows(ids, count)
    assert net.log_probabilities(window, ids) == pytest.approx(_plain_log(net, ids, count), abs=1e-6)
    # one step goes down the gradient, as differences of the plain loss have it
    steps, old = {}, {k: v.copy() for k, v in net.p.items()}
    net._step = lambda value, square, g, at: steps.setdefault(next(k for k, v in net.p.items() if v is value), (at, g))
    net.train(window, ids, {k: np.zeros(v.shape) for k, v in net.p.items()})
    net.p = old
    for k, (at, g) in steps.items():
        full = np.zeros_like(net.p[k])
        full[at] = g
        for j in rng.choice(np.flatnonzero(np.abs(full.ravel()) > 1e-4), 3):
            slope = []
            for d in (1e-5, -1e-5):
                net.p[k].ravel()[j] += d
                slope.append(-_plain_log(net, ids, count).mean())
                net.p[k].ravel()[j] -= d
            assert (slope[0] - slope[1]) / 2e-5 == pytest.approx(full.ravel()[j], rel=1e-3, abs=1e-7)


def test_network_gives_a_distribution():
    net = lm_score.Network.start(np.ones(lm_score.VOCABULARY))
    ids = np.arange(lm_score.VOCABULARY)
    window = np.tile(np.arange(4) * (lm_score.VOCABULARY + 1) + 7, (len(ids), 1)).astype(np.int32)
    assert np.exp(net.log_probabilities(window, ids)).sum() == pytest.approx(1, abs=1e-4)
    # and within each class, over the places that words fall on
    words = lm_score.Words(np.empty(0, np.uint64), np.random.default_rng(0).integers(0, 9, lm_score.PLACES).astype(float))
    assert np.exp(words.log_share.astype(float).reshape(-1, lm_score.OTHERS)).sum(0) == pytest.approx(np.ones(lm_score.OTHERS), abs=1e-3)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET", 20_000)
    monkeypatch.setattr(lm_score, "BLOCK", 3_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = []
    for n in (1, 8):
        words, f = lm_score.count(docs.repartition(n))
        rows = lm_score.encoded(docs.repartition(n, "text"), words, lm_score._buckets(f))
        assert lm_score._buckets(f) > 2
        got.append({r.doc_id: (r.n_words, r.log_probability) for r in lm_score._scores(rows, lm_score.train(rows, f)).collect()})
    assert got[0] == got[1] and len(got[0]) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(n == len(word_hashes([(texts[i] or "").lower().encode()])[0]) for i, (n, _) in got[0].items())


def test_toxicity_held_out(spark):
    rows = registry.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    labels = duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").df()
    m = rows.merge(labels, on="doc_id")
    m = m[m.held_out]
    hit, false = ((m.predicted == 1) & (m.toxic == 1)).sum(), ((m.predicted == 1) & (m.toxic == 0)).sum()
    assert hit >= 0.85 * (m.toxic == 1).sum() and false <= 0.01 * (m.toxic == 0).sum()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def toxic_corpus(seed=0, n=600):
    """Two languages; a fifth of the texts, toxic, have some of 16 words of their language's own among ordinary ones."""
    rng = random.Random(seed)
    rows, bad = [], {t: [f"{t}bad{k}" for k in range(16)] for t in "ab"}
    for i in range(n):
        t = "a" if rng.random() < 0.8 else "b"
        w = [f"{t}{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(80, 160))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(5, 9) if toxic else 0):
            w.insert(rng.randrange(20, 60), rng.choice(bad[t]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows, bad


def test_lexicon_is_induced(spark):
    """Words that no label touches get their weight from the walks alone."""
    rows, bad = toxic_corpus(n=1200)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    hidden = {w for t in bad for w in bad[t][::2]}
    name = {int(h): w for w in {w for _, t, _ in rows for w in t.split()} for h in word_hashes([w.encode()])[0].view(np.int64)}
    counts = Counter(w for _, t, x in rows for w in set(t.split()))
    toxic = Counter(w for _, t, x in rows for w in set(t.split()) if x)
    known = [(h, counts[w], 1 if w in toxic and "bad" in w else -1) for h, w in name.items() if w not in hidden and counts[w] >= 4]
    says = spark.createDataFrame(known, "word long, all long, says int")
    words = toxicity.polar_words(df.select("doc_id", "text"), says, len(rows))
    weight = dict(zip(words["word"].map(name), toxicity.weights(words)))
    found = {w for w, x in weight.items() if x > toxicity.POLAR}
    assert len(found & hidden) >= 14 and all("bad" in w for w in found)


def test_toxicity_does_not_depend_on_partitions(spark):
    rows, _ = toxic_corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = []
    for n in (1, 7):
        lexicon = toxicity.induce(df.repartition(n).select("doc_id", "text"), df.repartition(n, "text").select("doc_id", "toxic"))
        got.append((lexicon.words.tolist(), lexicon.weight.tolist(), lexicon.coefficient.tolist()))
        scores = np.array(lexicon.score([t for _, t, _ in rows]))
        assert ((scores >= 0.7) == (np.array([x for *_, x in rows]) == 1)).mean() > 0.98 and lexicon.score([None, ""]).max() < 0.1
    assert got[0] == got[1] and got[0][0]


def test_graph_and_walks(spark):
    """Near pairs, links and visits against a plain version."""
    rng = np.random.default_rng(0)
    docs = [(i, np.sort(rng.choice(90, 25, replace=False)).tolist(), rng.integers(0, 12, 25).tolist()) for i in range(60)]
    gaps = lambda p: [min(b - a, toxicity.REACH + 1) for a, b in zip([0, *p], p)]
    df = spark.createDataFrame([(gaps(p), t) for _, p, t in docs], "gap array<tinyint>, term array<short>")
    pairs = Counter()
    for _, p, t in docs:
        pairs.update({(min(t[a], t[b]), max(t[a], t[b])) for a in range(25) for b in range(a + 1, min(a + 9, 25)) if p[b] - p[a] <= 40 and t[a] != t[b]})
    got = df.repartition(5).mapInPandas(toxicity.near_pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    assert {(r.i, r.j): r.n for r in got.collect()} == pairs
    n = np.zeros((12, 12))
    for (i, j), c in pairs.items():
        n[i, j] = n[j, i] = c
    m, w = n.sum(1), np.zeros((12, 12))
    for i in range(12):
        for j in range(12):
            if n[i, j] > 1:
                w[i, j] = max(np.log((n[i, j] - n[i, j] ** 0.5) * n.sum() / (m[i] * m[j])), 0)
    p = w / np.maximum(w.sum(1, keepdims=True), 1e-12)  # fewer than LINKS links each
    steps = toxicity.graph(got)
    assert all(abs(r.p - p[r.i, r.j]) < 1e-5 for r in steps.collect()) and steps.count() == (w > 0).sum()
    says = np.array([1, 1, 0, 0, -1, -1, -1, 0, 0, 0, 0, 0])
    walk = []
    for s in (1, -1):
        start = (says == s) / (says == s).sum()
        at = start
        for _ in range(toxicity.STEPS):
            at = (1 - toxicity.ON) * start + toxicity.ON * at @ p
        walk.append(at)
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(says)], "i long, says int")
    for r in toxicity.polarity(nodes, steps).collect():
        assert r.polarity == pytest.approx(walk[0][r.i] / (walk[0] + walk[1])[r.i], abs=1e-4)


def test_pipeline(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = duckdb.sql(f"select doc_id, toxic from '{SMALL}/labels.parquet'").df()
    n = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas())
        n[name] = docs.toPandas()
    texts = dict(zip(n["toxicity"].doc_id, n["toxicity"].text))
    clean = set(labels[labels.toxic == 0].doc_id)
    assert len(clean - set(texts)) <= 0.02 * len(clean)
    normal = {}
    for i in sorted(texts):
        normal.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert set(n["exact_dedup"].doc_id) == set(normal.values())
    left = {i: texts[i] for i in normal.values()}
    assert set(n["simhash_near_dedup"].doc_id) == set(classes(left).values())
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_pieces", "ids"] and {r.doc_id for r in out.select("doc_id").collect()} <= set(left)
