"""Spelling variants, sharding and ranked search against brute force, on odd rows too."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from urbanframe.llm import lexical_search, queries, sharding, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, key long, word string, size int, n int, item int"


def frame(spark, rows):
    """(doc_id, text, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 0, 0.5, 1, "x", 2, 3, 4) for i, t, s in rows], SCHEMA)


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_stratified_shards", "op13_lexical_search"])
def test_sql(spark, name):
    query, sql = queries.ENTRIES[name]
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    df = query(spark, SF)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(map(repr, cur.fetchall()))


# ---------------------------------------------------------------- spelling variants
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def word_list(rnd, hot):
    letters = "abé"
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    words = {make(rnd.randint(1, 7)) for _ in range(250)}
    words |= {hot + make(rnd.randint(0, 4)) for _ in range(120)} | {make(3) + hot for _ in range(30)}
    words |= {"aaaa", "aaaaa", "aaaaaa", "z" * 90, "z" * 91, "z" * 45 + "y" + "z" * 45, "日本語", "日本", "日x語"}
    return {w: rnd.choice([5, 6, 30, 40, 200, 1000]) for w in sorted(words)}


@pytest.mark.parametrize("limit,window", [(4096, 32), (6, 2), (1, 1)])
def test_variants_against_brute_force(spark, limit, window):
    counts = word_list(random.Random(4), "abbaabé")
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(rows, 5, limit, window).collect()}
    assert got == brute_variants(counts)


def test_each_link_once_and_accepted_pairs(spark):
    counts = word_list(random.Random(5), "ab")
    rows = spark.createDataFrame([*counts.items(), ("aaaa", 1), (None, 3), ("", 2)], "word string, n long")
    for r in spelling.near_words(rows, limit=8).collect():
        got = [x["word"] for x in r["near"]]
        assert len(got) == len(set(got)) and set(got) == {x for x in counts if one_edit(r["word"], x)}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("ta", "to", "ra") for b in ("ps", "p", "ss"))
    a = spelling.Acceptor(words)
    assert a.size[a.start] == 9 and len(a.final) == 7  # shared endings are one state


def test_vocabulary_against_plain_count(spark):
    rnd = random.Random(6)
    base = ["Maison", "maison", "MAISON", "maisons", "éàüöñÿ", "Éàüöñÿ", "×÷×÷×÷", "short", "longword", "Ωmega"]
    texts = [" ".join(rnd.choice(base) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "1", "-x", "日"]) for _ in range(60)]
    texts += [None, "", "   ", "maison" * 3000, "ab " * 50_000, "\x00maison\x00"]
    rows = [(None if i == 7 else i, t, "s") for i, t in enumerate(texts)]
    rows += rows[:3]
    expected = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                expected[run] += 1
    got = {r["word"]: r["n"] for r in spelling.vocabulary(frame(spark, rows), 5, 6, 7).collect()}
    assert got == {w: n for w, n in expected.items() if n >= 5}


def test_variants_of_nothing(spark):
    docs = frame(spark, [])
    assert spelling.variants(spelling.vocabulary(docs)).collect() == []


# ---------------------------------------------------------------- shards
def shard_rows(spark):
    rnd = random.Random(8)
    sources = ["hot"] * 60 + ["b", "c", None, ""] * 7 + ["rare"]
    rows = [(i, rnd.choice(["", None, "é" * rnd.randint(0, 9), "copy"]), rnd.choice(sources)) for i in range(700)]
    rows += [(3, "copy", "hot")] * 40 + [(None, "copy", "hot")] * 30 + [(3, "other", "b")]
    return rows


def test_shards(spark):
    rows = shard_rows(spark)
    got = sharding.sharded(frame(spark, rows), 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["stratum"]) for r in got), key=key) == sorted(
        ((i, size(t), crc(t), s) for i, t, s in rows), key=key
    )
    by_shard = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    counts = [len(slots) for slots in by_shard.values()]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    whole = Counter(r["stratum"] for r in got)
    for s in range(8):
        here = Counter(r["stratum"] for r in got if r["shard"] == s)
        assert all(abs(here[x] - n / 8) <= 2 for x, n in whole.items())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    again = sharding.sharded(frame(spark, rows[::-1]), 8).collect()
    place = lambda rs: sorted(((r["doc_id"], r["size"], r["text_crc32"], r["stratum"], r["shard"], r["slot"]) for r in rs), key=key)
    assert place(again) == place(got)
    other = sharding.sharded(frame(spark, rows), 8, seed=1).collect()
    assert place(other) != place(got)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    got = sharding.sharded(frame(spark, [(i, "t", "s") for i in range(n)]), 8).collect()
    assert len(got) == n and len({r["shard"] for r in got}) == n and all(r["slot"] == 0 for r in got)


# ---------------------------------------------------------------- ranked search
def brute_ranked(docs, items, k=10):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    counted = [(i, Counter(find(t))) for i, t, _ in docs if find(t)]
    big_n, big_l = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in {*items}:
        scored = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * big_n // big_l
            s = 0
            for t in set(find(text)):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out |= {(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("block,leaf,group", [(1024, 16, 256), (16, 1, 3), (7, 3, 256)])
def test_search_against_brute_force(spark, block, leaf, group):
    rnd = random.Random(9)
    words = ["The", "the", "of", "é", "日本", "x1", "a-b", "rare", "Ünder", "q_r"] + [f"w{i}" for i in range(40)]
    make = lambda n: " ".join(rnd.choice(words[: rnd.randint(3, len(words))]) for _ in range(n))
    docs = [(i, make(rnd.randint(0, 50)), "s") for i in range(150)]
    docs += [(200 + i, docs[5][1], "s") for i in range(60)] + [(500, None, "s"), (501, "", "s"), (502, "?!", "s"), (503, "the " * 20_000, "s")]
    docs += [(None, docs[9][1], "s"), (4, docs[4][1], "s"), (4, docs[8][1], "s")]
    items = [(i, make(rnd.randint(1, 12))) for i in range(8)] + [(9, None), (10, ""), (11, "unknown"), (None, "rare x1"), (3, "rare the"), (12, docs[5][1])]
    listed = spark.createDataFrame([(i, t, 0, "x") for i, t in items + items[:2]], "item_id long, text string, rank int, score string")
    got = lexical_search.ranked(frame(spark, docs), listed, 10, block, leaf, group).collect()
    assert len(got) == len({tuple(r) for r in got}) or len(docs) != len(set(docs))
    assert {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got} == brute_ranked(docs, items)


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 9, 90)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    terms = np.concatenate([np.sort(rng.choice(30, s, replace=False)) for s in sizes])
    weight = rng.integers(0, 9000, 30)
    scores = weight[terms] * rng.integers(1, 1_000_000, len(terms))
    tree = lexical_search.BallTree(ends, terms, scores, weight, 4)
    items = rng.integers(0, 2, (20, len(tree.columns)))
    bounds = tree.bounds(items.astype(float))
    for number, (first, last, _, left, _) in enumerate(tree.nodes):
        for d in tree.order[first:last]:
            span = slice(ends[d], ends[d + 1])
            exact = items[:, tree.local[span]] @ scores[span]
            assert (exact <= bounds[number]).all()
        if left < 0:
            places, got = tree.leaf(number, items[0])
            assert got.tolist() == [int(items[0, tree.local[ends[d] : ends[d + 1]]] @ scores[ends[d] : ends[d + 1]]) for d in places]


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked(frame(spark, []), items).collect() == []
    assert lexical_search.ranked(frame(spark, [(1, "a", "s")]), items.where("item_id > 1")).collect() == []
