"""The text operators against brute force, round trips and held-out labels."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urbanframe.llm import (
    exact_dedup, license_scan, neighbours, packing, pieces, quality, queries, simhash, suffix_dedup, token_counts, toxicity, word_bpe,
)
from urbanframe.llm.common import components
from urbanframe.llm.labelled import auc

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, key long"


def documents(spark, texts):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rnd = random.Random(3)
    words = ["the", "of", "Ünder", "licence", "mit", "MIT", "license", "日本", "42,", "a.b", "x"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [make(n) for n in (1, 2, 3, 40, 200, 400)]
    near = base[4].split()
    near[7] = "changed"
    passage = make(60)
    return [
        None, "", " ", "\n\n", *base, *base[:5], base[3].upper(), " ".join(near), "z" * 700, "z" * 650, make(12) + passage + make(9),
        passage, make(30) + "\n" + passage, "é" * 180, "Released under the MIT License.\n" + make(20), make(6000), None, "",
    ]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---------------------------------------------------------------- near and exact duplicates
def plain_fingerprint(text, words):
    parts = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not parts:
        return 0
    n = min(words, len(parts))
    h = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + n]), 42) for i in range(len(parts) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, near):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_simhash_groups(spark):
    texts = odd_texts()
    got = by_id(simhash.near_groups(documents(spark, texts)))
    prints = [plain_fingerprint(t, 3) for t in texts]
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [got[i].p0 & (2**64 - 1) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == want


def test_crowded_keys_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIMIT", 8)
    rnd = random.Random(1)
    values = {0xABCDEF0123456789}
    while len(values) < 400:
        x = rnd.choice(sorted(values))
        for _ in range(rnd.choice([1, 2, 3, 5])):
            x ^= 1 << rnd.randrange(64)
        values.add(x)
    values = sorted(values)
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(signed, "node long, p0 long")
    matcher = simhash._Matcher(simhash.Halves(), 0, 3)
    assert matcher.last is False
    links = simhash.links(nodes, simhash.Halves(), 3).collect()
    assert all((values[r.a] ^ values[r.b]).bit_count() <= 3 for r in links)
    root = plain_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    edges = spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert [got.get(i, i) for i in range(len(values))] == root


@pytest.mark.parametrize(("rows", "centres"), [(50, 5), (700, 30), (2500, 1), (2500, 300)])
def test_whole_buckets_lose_no_link(rows, centres):
    rng = np.random.default_rng(rows + centres)
    values = rng.integers(0, 1 << 63, (centres, 3)).astype(np.uint64)[rng.integers(0, centres, rows)]
    for _ in range(14):
        values[np.arange(rows), rng.integers(0, 3, rows)] ^= np.uint64(1) << rng.integers(0, 64, rows).astype(np.uint64)
    values = rng.permutation(np.unique(values, axis=0))
    n, bit = len(values), (values[:, 1] >> np.uint64(7)) & np.uint64(1)
    near = np.concatenate([simhash._distance(values[i : i + 64, None], values[None]) <= 20 for i in range(0, n, 64)])
    want = simhash._lowest(n, *np.nonzero(near)).tolist()
    assert simhash._lowest(n, *simhash.links_within(values, -1, 20)).tolist() == want
    links = [simhash.links_within(values, 64 + 7, 20)]  # across the bit left out; the rest meets under the full key
    assert (bit[links[0][0]] != bit[links[0][1]]).all()
    for side in (0, 1):
        own = np.flatnonzero(bit == side)
        links.append([own[x] for x in simhash.links_within(values[own], -1, 20)])
    assert simhash._lowest(n, *(np.concatenate(x) for x in zip(*links, strict=True))).tolist() == want


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 180)]
    edges = spark.createDataFrame(path + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}


def edited(rnd, base, places):
    own = list(base)
    for i in places:
        own[i] = f"x{rnd.randrange(10**9)}"
    return own


def test_near_copies_of_rows_without_id(spark):
    docs = documents(spark, [" ".join(f"w{i}" for i in range(200))] * 3 + ["a b c"])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))
    # a copy without id goes like any other
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["1", "3"]
    rnd = random.Random(0)
    base, other = [f"v{rnd.randrange(10**6)}" for _ in range(3000)], None
    prints = [plain_fingerprint(" ".join(base), 3)]
    while other is None or not 0 < (plain_fingerprint(other, 3) ^ prints[0]).bit_count() <= 3:
        other = " ".join(edited(rnd, base, [rnd.randrange(3000)]))
    docs = documents(spark, [" ".join(base), other]).withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))
    assert [r.component_id for r in simhash.near_groups(docs).collect()] == [1, 1]


def plain_near_kept(texts):
    """Places of the texts that stay: the first of each component of fingerprints with three or fewer differing bits."""
    prints = [plain_fingerprint(t, 3) for t in texts]
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    return [i for i, c in enumerate(want) if i == c]


def test_near_copies_leave_one(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rnd = random.Random(5)
    long = [rnd.choice([f"w{i}" for i in range(500)]) for _ in range(4000)]
    texts = [r.text for r in rows] + odd_texts() + [" ".join(edited(rnd, long, [rnd.randrange(4000)])) for _ in range(12)]
    kept = simhash.keep_one(documents(spark, texts))
    stays = plain_near_kept(texts)
    assert sorted(r.doc_id for r in kept.collect()) == stays and len(stays) < len(texts) - 5
    assert kept.columns == documents(spark, []).columns


def odd_rows(spark):
    """Repeated and missing ids with equal and other texts."""
    rows = [
        (5, "alpha beta gamma delta"), (5, "only this text is unique"), (9, "Alpha beta gamma delta"), (None, "alpha beta gamma delta"),
        (None, "a text without any id"), (None, "a text without any id"), (7, "repeated row of words"), (7, "repeated row of words"), (8, None), (3, ""),
    ]
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, 1) for i, t in rows], SCHEMA)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_no_text_is_lost_with_a_repeated_or_missing_id(spark):
    docs = odd_rows(spark)
    want = [
        (5, "only this text is unique"), (9, "Alpha beta gamma delta"), (None, "a text without any id"), (None, "a text without any id"),
        (7, "repeated row of words"), (7, "repeated row of words"), (8, None),
    ]
    assert left(exact_dedup.keep_one(docs)) == sorted(want, key=repr)
    # near copies: the smallest id; lower-cased texts have equal fingerprints, the two rows without id are one text
    want = [
        (5, "alpha beta gamma delta"), (5, "only this text is unique"), (None, "a text without any id"), (None, "a text without any id"),
        (7, "repeated row of words"), (7, "repeated row of words"), (3, ""),
    ]
    assert left(simhash.keep_one(docs)) == sorted(want, key=repr)


def test_toxic_rows_go_by_their_own_text(spark):
    good, bad = "the river runs by the quiet mill", "worthless vile scum liars"
    rows = [(i, bad if i % 2 else good + f" number{i}") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    rows += [(1000, bad), (1000, good), (None, bad), (None, good), (1001, None), (1002, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0.5, 1) for i, t in rows], SCHEMA)
    kept = left(toxicity.keep_clean(docs, labels))
    assert (1000, good) in kept and (None, good) in kept and not [r for r in kept if r[1] == bad]


@pytest.mark.parametrize("options", [{}, {"capacity": 2, "bits": 2}, {"hash_bits": 2}])
def test_exact_groups(spark, options):
    texts = odd_texts()
    got = by_id(exact_dedup.groups_of(documents(spark, texts), **options))
    low = ["".join(c.lower() if c.isascii() else c for c in t or "") for t in texts]
    for i, t in enumerate(low):
        same = [j for j, u in enumerate(low) if u == t]
        want = (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == want


def test_directory_settles_every_slot(spark):
    slots = spark.range(300).select(F.xxhash64("id").alias("h")).union(spark.range(3).select((F.col("id") - 5).alias("h")))
    got = exact_dedup.directory(slots, capacity=4, bits=3)
    assert got.count() == 303
    assert got.groupBy("depth", "prefix").count().agg(F.max("count")).first()[0] <= 4


# ---------------------------------------------------------------- passages
def plain_passages(texts, length):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [4096, 0])
def test_passages(spark, crowded):
    texts = odd_texts()
    got = by_id(suffix_dedup.measured(documents(spark, texts), crowded=crowded))
    found = [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))]
    assert found == plain_passages(texts, 100)


def test_passages_of_repeated_rows_and_whole_characters(spark):
    text = "é" * 180
    docs = documents(spark, [text, text, "ab" + text])
    docs = docs.union(docs.where("doc_id = 0")).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    kept = suffix_dedup.keep_first(docs)
    rows = [(r.doc_id, r.text, r.n_chars) for r in kept.collect()]
    assert kept.columns == docs.columns and len(rows) == 5
    assert all(len(t) == n for _, t, n in rows)
    assert [t for i, t, _ in rows if i == 2] == ["ab"] and [t for i, t, _ in rows if i is None] == [text]


@pytest.mark.parametrize("crowded", [4096, 0])
def test_repeated_rows_keep_the_first_occurrence(spark, crowded):
    rnd = random.Random(9)
    make = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = make(250)
    texts = [make(200) + passage + make(150), make(180) + passage + make(160), make(500)]
    docs = documents(spark, texts)
    for again in (0, 0, 1, 2):
        docs = docs.union(docs.where(f"doc_id = {again}").limit(1))
    want = dict(enumerate(plain_passages(texts, 100)))
    rows = suffix_dedup.measured(docs, crowded=crowded).collect()
    assert len(rows) == 7 and want[0][1] == 0 and want[1][1] >= 250
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == [want[r.doc_id] for r in rows]
    kept = suffix_dedup.keep_first(docs, crowded=crowded).collect()
    assert all(r.text == texts[r.doc_id] for r in kept if r.doc_id != 1) and len({r.text for r in kept if r.doc_id == 1}) == 1


def test_interval_expansion_finds_common_prefixes():
    rng = np.random.default_rng(4)
    symbols = np.append(rng.integers(1, 4, 400), 0).astype(np.uint16)
    for length in (1, 3, 8, 20):
        order, border = suffix_dedup.equal_windows(symbols, length)
        twice = np.concatenate((symbols, symbols))
        cut = [tuple(twice[i : i + length]) for i in order]
        assert cut == sorted(cut)
        assert [bool(b) for b in border] == [True, *(a != b for a, b in zip(cut, cut[1:], strict=False))]


# ---------------------------------------------------------------- licences
def test_licence_blocks_against_every_pair(spark):
    texts = odd_texts() + ["This program is free software you can redistribute it and or modify it under the terms of the GNU General Public", "mit apache license mit license"]
    docs = documents(spark, texts).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).withColumn("h", F.xxhash64("low"))
    got = {(r.doc_id, r.line, r.template): r.share for r in license_scan.matches(spark, docs, 0.6).collect()}
    want = {}
    import re

    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").lower().split("\n")):
            words = set(re.findall(license_scan.WORD, line))
            for k, (_, t) in enumerate(license_scan.TEMPLATES):
                own = set(t.split())
                if len(own & words) >= license_scan.needed(len(own), 0.6):
                    want[i, n, k] = len(own & words) / len(own)
    assert got == want and want
    rows = by_id(license_scan.scanned(spark, documents(spark, texts)))
    assert (rows[len(texts) - 1].n_base, rows[len(texts) - 1].first_word, rows[len(texts) - 1].base_labels) == (2, 1, "apache,mit")
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)


# ---------------------------------------------------------------- classifiers
def labelled(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    labels = read("labels").limit(2500)
    return read("documents").join(labels.select("doc_id"), "doc_id", "left_semi"), labels


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_scores(spark, module, label):
    docs, labels = labelled(spark)
    rows = module.rated(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows.score.to_numpy(), rows[label].to_numpy()) > 0.95
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all()


def test_classifiers_without_labels(spark):
    docs = documents(spark, ["a b", None, ""])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        rows = module.rated(docs, labels).collect()
        assert len(rows) == 3 and all(0 <= r.score < 0.3 and r.predicted == 0 for r in rows)


def test_swapping_keeps_group_mentions_neutral():
    features = [10, 11, 12, 13]  # an insult, one group, another group, a plain word
    texts = [[0, 1]] * 40 + [[1, 3]] * 5 + [[2, 3]] * 40 + [[3]] * 40
    y = np.array([1.0] * 40 + [0.0] * 85)
    pairs = [([0, 1], [0, 2])] * 40 + [([1, 3], [2, 3])] * 5 + [([2, 3], [1, 3])] * 40
    plain, fair = toxicity.fit(features, texts, y, []), toxicity.fit(features, texts, y, pairs)
    gap = lambda m: abs(m.weights[11] - m.weights[12])
    assert gap(fair) < 0.2 * gap(plain) and fair.weights[10] > 1
    assert toxicity.swapped("women", 0) == "men" and toxicity.swapped("stone", 0) == "stone"


def test_pairwise_sum_identity():
    rng = np.random.default_rng(0)
    machine = quality.Machine([], np.zeros((0, 9)), 0.3, rng.normal(size=30), rng.normal(size=(30, 8)))
    at = [1, 4, 7, 22]
    v = machine.factors
    pairs = sum(float(v[i] @ v[j]) for n, i in enumerate(at) for j in at[:n])
    assert abs(machine.logit(at) - (0.3 + machine.linear[at].sum() + pairs)) < 1e-9


# ---------------------------------------------------------------- tokens
def test_word_ids_are_those_of_the_tokenizer():
    import pyarrow as pa

    texts = [t or "" for t in odd_texts()] + ["It's DON'T 'll", "a <|endoftext|> b", "İstanbul ΣΑΣ ß ẞ", "a\tb\r\n c\x85d", "ab." * 50, "\x00"]
    encoder = word_bpe.WordEncoder(WORDS)
    ids, at = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encoder.library.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    texts = odd_texts() + ["word " * 9000]
    rows = packing.pack(documents(spark, texts), WORDS, capacity=512).collect()
    library = Tokenizer.from_file(WORDS)
    whole = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for i, ids in whole.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 512)) and sum(r.length for r in own) == len(ids)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 512
    assert len(sequences) <= 1 + -(-sum(map(len, whole.values())) // 512)


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_plans_place_everything_once(n):
    sizes = np.clip(np.random.default_rng(n).lognormal(5.5, 1, n).astype(int), 1, 1024)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True), strict=True)}
    plan = packing.plan(histogram, 1024)
    used, held = {}, {}
    for length, first, many, sequence, offset in plan.tolist():
        assert first == held.get(length, 0)
        held[length] = first + many
        for s in range(sequence, sequence + many):
            used.setdefault(s, []).append((offset, length))
    assert held == histogram
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))] and sum(x for _, x in parts) <= 1024
    assert len(used) <= 1.02 * -(-int(sizes.sum()) // 1024) + 1


def best_pieces(model, text):
    """Dynamic programming over the whole text."""
    held, raw = " " + text.replace("▁", pieces.NO_PIECE), " " + text
    held = held.replace(" ", "▁")
    best = [(0.0, ())]
    for end in range(1, len(held) + 1):
        top = None
        for start in range(max(0, end - model.longest), end):
            found = model.score.get(held[start:end])
            if found and (top is None or best[start][0] + found[0] > top[0]):
                top = (best[start][0] + found[0], (*best[start][1], found[1]))
        if held[end - 1] not in model.score and (top is None or best[end - 1][0] + model.fallback > top[0]):
            top = (best[end - 1][0] + model.fallback, (*best[end - 1][1], *model.bytes_of(raw[end - 1])))
        best.append(top)
    return list(best[-1][1]) if text else []


def test_pieces_are_best_and_come_back(spark):
    model = pieces.model(PIECES)
    texts = [t for t in odd_texts() if t is not None and len(t) < 3000] + ["  a   b ", "▁x ▁", "<s> <0x0A>\x00", "日本語́", "q" * 900]
    for t in texts:
        ids = np.frombuffer(model.encode(t), "<i4").tolist()
        assert ids == best_pieces(model, t) and model.decode(ids) == t
        run, out = pieces.StreamingViterbi(model), []
        for i in range(0, len(t) + 1 if t else 0, 5):
            out += run.feed(f" {t}"[i : i + 5])
        assert out + run.finish() == ids and (run.window < 80 or " " not in t)
    docs = documents(spark, texts + [None])
    back = by_id(pieces.decoded(pieces.encoded(docs, PIECES), PIECES))
    assert [back[i].text for i in range(len(texts))] == texts and back[len(texts)].text == ""


def test_a_long_run_takes_time_in_proportion():
    model, took = pieces.model(PIECES), []
    for n in (100_000, 1_000_000):
        start = time.perf_counter()
        ids = model.encode("a" * n)
        took.append(time.perf_counter() - start)
        assert model.decode(np.frombuffer(ids, "<i4").tolist()) == "a" * n
    assert took[1] < 40 * max(took[0], 0.05)


def test_edits_count_like_a_fresh_text():
    counts, rnd = token_counts.counter(BYTES), random.Random(2)
    bits = ["a", "b", " ", "  ", "'", "l", "ll", "1", "é", "\n", "\t", "!", "can't", "we'll", " x", "日"]
    for _ in range(300):
        text = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 3, 60, 300])))
        tree = token_counts.SegmentTree(text, counts)
        for _ in range(4):
            a = rnd.randrange(len(text) + 2)
            b, new = a + rnd.choice([0, 1, 5, 200]), "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 9, 200])))
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(a, min(b, len(text))) :]
            assert tree.text() == text and tree.count == len(counts.library.encode_ordinary(text)) and tree.length == len(text)


def test_kept_trees_are_taken_up_as_they_are(spark):
    docs = documents(spark, [t for t in odd_texts() if t is None or len(t) < 3000])
    counts = token_counts.counter(BYTES)
    for r in token_counts.trees(docs, BYTES, token_counts.scrubbing).collect():
        text = {d.doc_id: d.text or "" for d in docs.collect()}[r.doc_id]
        fresh = token_counts.SegmentTree(text, counts)
        assert r.sizes == [len(t) for leaf in fresh.leaves for t in leaf] and r.n_tokens == fresh.count == sum(r.sums)
        kept = token_counts.SegmentTree(text, counts, r.sizes, r.sums)
        assert (kept.chars, kept.tokens, kept.leaves) == (fresh.chars, fresh.tokens, fresh.leaves)
        assert (r.text is None) == (not r.edits)


def test_scrubbing_looks_away_only_where_there_is_nothing():
    rnd = random.Random(4)
    for _ in range(2000):
        text = "".join(rnd.choice(["a", "@", ".", "1", "12345", "!", "!!!", "--", " ", "\n", "٣", "###x"]) for _ in range(12))
        end = len(text.rstrip())
        want = [(m.start(), m.end()) for m in token_counts._SCRUB.finditer(text)]
        got = token_counts.scrubbing(text)[::-1]
        if end < len(text):
            want = [e for e in want if e[1] <= end] + [(end, len(text))]
        assert [e[:2] for e in got] == want


def test_edit_column(spark):
    docs = documents(spark, ["hello world", None]).withColumn("edits", F.expr("array(struct(0 AS start, 5 AS stop, 'bye' AS text), null)"))
    rows = by_id(token_counts.counted(docs, BYTES))
    assert (rows[0].n_edits, rows[0].n_chars_edited, rows[1].n_tokens) == (1, 9, 0)


# ---------------------------------------------------------------- neighbours
def test_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[50:450] = x[50]  # a very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [nan] * 16), (2300, [inf] * 16), (2400, [1.0] * 3), (None, [1.0] * 16), (2500, [None] * 16), rows[7]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = neighbours.nearest(df, k=10, every=50, cell_rows=300, block_rows=200, chunk=16).collect()
    hit, queries_ = 0, range(0, 1500, 50)
    for q in queries_:
        away = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        away[q] = np.inf
        want = np.lexsort((np.arange(1500), away))[:10].tolist()
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r.score - away[r.vec_id]) < 1e-9 for r in own)
        hit += len(set(want) & {r.vec_id for r in own})
    assert len(got) == 300 and hit >= 0.9 * 300


def test_longer_odd_vectors_do_not_set_the_dimension(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(20)]
    odd = [(100, [1.0] * 4 + [None]), (200, [float("nan")] * 6), (300, [0.0] * 7), (400, [1.0] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, k=2, every=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (10, 1, 9), (10, 2, 11)]


def test_vectors_of_doubles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) + 1e-9 * rng.normal(size=(300, 8))  # differences that floats would lose
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for r in neighbours.nearest(df, k=3, every=50, cell_rows=100, block_rows=80, chunk=16).collect():
        assert abs(r.score - float(np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum()))) < 1e-12


# ---------------------------------------------------------------- all together
def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    results = [
        simhash.near_groups(docs), license_scan.scanned(spark, docs), toxicity.rated(docs, labels), pieces.round_trip(docs, PIECES),
        suffix_dedup.measured(docs), exact_dedup.groups_of(docs), quality.rated(docs, labels),
        token_counts.counted(docs, BYTES, token_counts.scrubbing), neighbours.nearest(vectors), packing.pack(docs, WORDS),
        toxicity.keep_clean(docs, labels), exact_dedup.keep_one(docs), simhash.keep_one(docs), suffix_dedup.keep_first(docs),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline_against_its_parts(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = read("documents")
    kept = by_id(docs)
    gone = {r.doc_id for r in toxicity.rated(docs, read("labels")).where("predicted = 1").collect()}
    low = {}
    for i in sorted(set(kept) - gone):
        low["".join(c.lower() if c.isascii() else c for c in kept[i].text)] = i
    left = sorted(low.values())
    left = [left[i] for i in plain_near_kept([kept[i].text for i in left])]
    sizes = [n - gone_ for n, gone_, _, _ in plain_passages([kept[i].text for i in left], 100)]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r.doc_id for r in rows}) == left and len(sizes) == len(left)
    assert all(r.length == 1 for r in rows if r.doc_id in {i for i, n in zip(left, sizes, strict=True) if n == 0})


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Repeated and missing ids, null texts, further columns, and an empty table, through all stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("odd", odd_rows(spark)), ("none", odd_rows(spark).limit(0))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(folder / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(folder)).collect()
        places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
        assert all(b[1] == a[1] + a[2] for a, b in zip(places, places[1:]) if a[0] == b[0])
        ids = sorted(str(r.doc_id) for r in rows)
        assert ids == ([] if name == "none" else sorted(["5", "9", "None", "None", "7", "7", "8"]))


def test_every_query_is_registered():
    assert [k.split("_")[0] for k in queries.ENTRIES] == [f"op{i}" for i in range(1, 14)]
