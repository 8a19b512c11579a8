"""SimHash near-duplicates by deletion variants.

A fingerprint is cut into so few segments that of two fingerprints within
``max_bits`` one segment differs by one bit at most. Each segment is indexed
exactly and once for each of its bits left out, so an equality on these keys
finds every such pair; the whole fingerprints are then compared. Equal
fingerprints are one node before that, so copies travel once.

A key with many fingerprints (a large group of near copies) is never compared
in one task. Its members differ only in the rest of their bits, which are cut
again the same way, up to three levels deep; a bucket of the last level fixes all
but 11 bits and so holds 2048 fingerprints at most.

A document without words has fingerprint zero and is linked like any other;
null text counts as empty. Rows without ``doc_id`` take part with their
fingerprint, but are nobody's smallest id. Repeated rows share a node. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.common import components, shared, text_blocks, without_rows

SEED = 42
#: Fingerprints of one key that are compared with each other; more are cut again.
LIMIT = 2048
#: Groups up to this size are compared row against shifted row.
SHIFTED = 32
SHINGLES_AT_ONCE = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of the lower-cased text, in blocks."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    words = min(words, len(parts))
    starts, ends, digest = start[: len(parts) + 1 - words].tolist(), end[words - 1 :].tolist(), xxhash.xxh64_intdigest
    for i in range(0, len(starts), SHINGLES_AT_ONCE):
        j = i + SHINGLES_AT_ONCE
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:j], ends[i:j], strict=True)], np.uint64)


def fingerprint(text: str, words: int, prints: int = 1) -> list[int]:
    """``prints`` independent 64-bit fingerprints: a bit is 1 if set in over half the shingle hashes."""
    held, n = np.zeros((prints, 64), np.int64), 0
    for h in shingle_hashes(text, words):
        n += len(h)
        for p in range(prints):
            own = mixed(h + np.uint64(p) * np.uint64(0x9E3779B97F4A7C15)) if p else h
            held[p] += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * held > n, axis=1).view(">i8").ravel().tolist()


def fingerprints(docs: DataFrame, words: int = 3, prints: int = 1, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, ``carried`` (long) and the fingerprints p0, p1, ... (long) of every document."""
    names = [f"p{i}" for i in range(prints)]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            found = np.array([fingerprint(x, words, prints) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).cast(pa.int64()) for c in ("doc_id", *carried)), *(pa.array(found[:, i]) for i in range(prints))],
                names=["doc_id", *carried, *names],
            )

    return docs.select("doc_id", *carried, "text").mapInArrow(take, ", ".join(f"{c} long" for c in ("doc_id", *carried, *names)))


class Halves:
    """Exact for up to three differing bits of one fingerprint: halves of what is left, level by level."""

    prints, levels, wildcards = 1, 3, True

    @staticmethod
    def limit(level: int) -> int:
        return LIMIT

    @staticmethod
    def segments(path: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
        """For each choice at this level the (print, shift, bits) it fixes."""
        low, bits = 0, 64
        for choice in path:
            bits //= 2
            low += 0 if choice == 0 else bits  # the upper half was fixed: the lower is left
        bits //= 2
        return [[(0, low + bits, bits)], [(0, low, bits)]]


def _variants(scheme, path: tuple[int, ...], parent: np.ndarray, values: np.ndarray):
    """Rows (key, bit left out or -1, choice) for each way to index the fingerprints ``values`` (n, prints)."""
    for choice, parts in enumerate(scheme.segments(path)):
        base = mixed(parent + np.uint64(len(path) * 64 + choice + 1))
        for p, shift, bits in parts:
            held = (values[:, p] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            key = mixed(base ^ mixed(held + np.uint64(1)))
            base = key
        yield choice, -1, base
        if scheme.wildcards and len(parts) == 1:
            p, shift, bits = parts[0]
            start = mixed(parent + np.uint64(len(path) * 64 + choice + 1))
            for bit in range(bits):
                less = held & ~np.uint64(1 << bit)
                yield choice, p * 64 + shift + bit, mixed(mixed(start ^ np.uint64(bit + 1)) ^ mixed(less + np.uint64(1)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _differ(a: np.ndarray, b: np.ndarray, wild: np.ndarray) -> np.ndarray:
    """Whether the bit that the key leaves out differs; pairs without such a bit meet under the full key."""
    p, shift = np.maximum(wild, 0) // 64, (np.maximum(wild, 0) % 64).astype(np.uint64)
    rows = np.arange(len(a))
    return (wild < 0) | (((a[rows, p] ^ b[rows, p]) >> shift) & np.uint64(1)).astype(bool)


def _lowest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the first row of its component."""
    top = np.arange(n)
    while len(left):
        low = np.minimum(top[left], top[right])
        before = top.copy()
        np.minimum.at(top, left, low)
        np.minimum.at(top, right, low)
        top = top[top]
        if (before == top).all():
            break
    return top


def _join(values: np.ndarray, top: np.ndarray, side: np.ndarray, across: bool, max_bits: int):
    """Joins the components ``top`` wherever near rows of one side (``across``: of two sides) lie in two of them.

    Returns the new components and the links that joined them. Rows of the
    largest component need not be compared with each other, so a large group of
    near copies costs little more than one comparison a row; everything else is
    compared with all rows, in blocks.
    """
    n = len(values)
    step = max(1, (1 << 19) // n)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def compare(own: np.ndarray, top: np.ndarray) -> np.ndarray:
        near = _distance(values[own, None], values[None]) <= max_bits
        near &= ((side[own, None] != side) == across) & (top[own, None] != top)
        a, b = np.nonzero(near)
        if not len(a):
            return top
        a = own[a]
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        _, one = np.unique(low * n + high, return_index=True)
        above, kept = {}, []
        for k in one.tolist():
            ends = []
            for x in (int(low[k]), int(high[k])):
                while x in above:
                    x = above[x]
                ends.append(x)
            if ends[0] != ends[1]:
                above[max(ends)] = min(ends)
                kept.append(k)
        left.append(a[kept])
        right.append(b[kept])
        return _lowest(n, low[kept], high[kept])[top]

    rest, tries = np.arange(n), 8 if n > step else 0
    for _ in range(tries):  # a row of a large group finds most of it
        top = compare(rest[:1], top)
        rest = np.flatnonzero(top != np.bincount(top).argmax())
        if not len(rest):
            break
    largest = np.bincount(top).argmax() if tries else -1
    for i in range(0, len(rest), step):
        own = rest[i : i + step]
        own = own[top[own] != top[largest]] if tries else own
        if len(own):
            top = compare(own, top)
    return top, np.concatenate(left), np.concatenate(right)


def _side(values: np.ndarray, wild: int) -> np.ndarray:
    """The bit that a key leaves out, 0 under a full key."""
    return np.zeros(len(values), np.uint64) if wild < 0 else (values[:, wild // 64] >> np.uint64(wild % 64)) & np.uint64(1)


def links_within(values: np.ndarray, wild: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of one key; blocks bound the memory.

    Under a full key every row gets a link to the first of its component. Under a
    key with a bit left out, rows that agree in that bit meet under the full key
    anyway, so only what joins their components is returned.
    """
    n = len(values)
    side = _side(values, wild)
    top, _, _ = _join(values, np.arange(n), side, False, max_bits)
    if wild < 0:
        rows = np.flatnonzero(top != np.arange(n))
        return rows, top[rows]
    return _join(values, top, side, True, max_bits)[1:]


class _Matcher:
    """Reads rows sorted by key and returns links, or the rows of an overfull key under their next keys."""

    def __init__(self, scheme, level: int, max_bits: int):
        self.scheme, self.level, self.max_bits = scheme, level, max_bits
        self.last, self.limit = level + 1 == scheme.levels, scheme.limit(level)
        self.hot: int | None = None

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "wild", "path", *(f"p{i}" for i in range(self.scheme.prints))]
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1], side="left"))
            yield from self.groups([x[:cut] for x in held])
            held = [x[cut:] for x in held]
            if not self.last and (len(held[0]) > self.limit or held[0][0] == self.hot):
                self.hot = held[0][0]
                yield from self.cut(held)
                held = [x[:0] for x in held] if len(held[0]) > 0 else held
        if held is not None:
            yield from self.groups(held)

    def groups(self, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, wild, _, *prints = held
        if not len(key):
            return
        values = np.stack(prints, 1).view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        large = (size > SHIFTED) | (key[first] == self.hot) if self.hot is not None else size > SHIFTED
        small = np.repeat(~large & (size > 1), size)
        at = np.flatnonzero(small)
        a, b = [], []
        for j in range(1, SHIFTED):
            at = at[at + j < len(key)]
            at = at[key[at + j] == key[at]]
            if not len(at):
                break
            x, y = values[at], values[at + j]
            near = (_distance(x, y) <= self.max_bits) & _differ(x, y, wild[at])
            a.append(node[at[near]])
            b.append(node[at[near] + j])
        for i, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
            own = [x[i : i + n] for x in held]
            if not self.last and (n > self.limit or key[i] == self.hot):
                yield from self.cut(own)
            else:
                rows, top = links_within(values[i : i + n], int(wild[i]), self.max_bits)
                a.append(node[i + rows])
                b.append(node[i + top])
        if a and sum(map(len, a)):
            yield self.out(a=np.concatenate(a), b=np.concatenate(b))

    def cut(self, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, _, path, *prints = held
        values, parent = np.stack(prints, 1).view(np.uint64), key.view(np.uint64)
        for own in np.unique(path):
            at = path == own
            yield from self.indexed(_unpacked(int(own)), parent[at], node[at], values[at])

    def indexed(self, path, parent, node, values) -> Iterator[pa.RecordBatch]:
        for choice, wild, key in _variants(self.scheme, path, parent, values):
            yield self.out(key=key.view(np.int64), node=node, wild=wild, path=_packed((*path, choice)), values=values.view(np.int64))

    def out(self, **x) -> pa.RecordBatch:
        n = len(x["a"]) if "a" in x else len(x["key"])
        none = pa.nulls(n, pa.int64())
        whole = lambda c, t: pa.array(np.full(n, x[c]), t) if c in x else pa.nulls(n, t)
        prints = [pa.array(x["values"][:, i]) if "values" in x else none for i in range(self.scheme.prints)]
        a, b, key, node = (pa.array(x[c], pa.int64()) if c in x else none for c in ("a", "b", "key", "node"))
        return pa.RecordBatch.from_arrays(
            [a, b, key, node, whole("wild", pa.int32()), whole("path", pa.int32()), *prints],
            names=["a", "b", "key", "node", "wild", "path", *(f"p{i}" for i in range(self.scheme.prints))],
        )


def _packed(path: tuple[int, ...]) -> int:
    return sum((c + 1) << (5 * i) for i, c in enumerate(path))


def _unpacked(path: int) -> tuple[int, ...]:
    return tuple((path >> (5 * i) & 31) - 1 for i in range(6) if path >> (5 * i) & 31)


def links(nodes: DataFrame, scheme, max_bits: int) -> DataFrame:
    """Links (a, b) that connect every pair of nodes (node, p0, ...) found within ``max_bits``.

    Not every pair is a row: the nodes under one key come as stars, so that a
    large group stays linear, and the components are those of all pairs.
    """
    names = [f"p{i}" for i in range(scheme.prints)]
    schema = "a long, b long, key long, node long, wild int, path int, " + ", ".join(f"{p} long" for p in names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(scheme, 0, max_bits)
        for batch in batches:
            values = np.stack([batch.column(p).to_numpy() for p in names], 1).view(np.uint64)
            yield from matcher.indexed((), np.zeros(len(values), np.uint64), batch.column("node").to_numpy(), values)

    rows, found = nodes.mapInArrow(index, schema), None
    for level in range(scheme.levels):
        matcher = _Matcher(scheme, level, max_bits)
        rows = rows.drop("a", "b").repartition("key").sortWithinPartitions("key")
        got = shared(rows.mapInArrow(matcher.rows, schema))
        own = got.where("a is not null").select("a", "b")
        found = own if found is None else found.union(own)
        rows = got.where("key is not null")
        if rows.isEmpty():
            break
    return found


def _candidates(found: DataFrame, scheme, max_bits: int) -> DataFrame:
    """The fingerprints p0, ... of ``found`` (doc_id, p0, ...) with their smallest id ``first``, and ``top``, one of each component."""
    names = [f"p{i}" for i in range(scheme.prints)]
    nodes = found.groupBy(*names).agg(F.min("doc_id").alias("first"))
    nodes = shared(nodes.withColumn("node", F.monotonically_increasing_id()))
    groups = components(links(nodes.select("node", *names), scheme, max_bits))
    return nodes.join(groups, "node", "left").select(*names, "first", F.coalesce("component", "node").alias("top"))


def near_groups(docs: DataFrame, words: int = 3, max_bits: int = 3, scheme=None) -> DataFrame:
    """doc_id, the fingerprints p0, ..., and component_id (smallest linked doc_id, its own included)."""
    scheme = scheme or Halves()
    names = [f"p{i}" for i in range(scheme.prints)]
    found = shared(fingerprints(docs, words, scheme.prints))
    nodes = shared(_candidates(found, scheme, max_bits))
    lowest = nodes.groupBy("top").agg(F.min("first").alias("component_id"))
    nodes = shared(nodes.join(lowest, "top").select(*names, "component_id"))
    return found.join(nodes, names).select("doc_id", *names, "component_id")


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each group of linked fingerprints, with the columns as they came.

    The smallest doc_id stays, rows without one only where a group has none; of
    several texts under that id the one of smallest digest stays. Rows are told apart
    by id and text: a repeated row stays with its like, another text under the id of
    a row that goes is judged by its own group.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    found = shared(fingerprints(docs.select("doc_id", "text").withColumn("h", digest), words, 1, ["h"]))
    tops = shared(_candidates(found, Halves(), max_bits).select("p0", "top"))
    rows = shared(found.join(tops, "p0").select("top", "doc_id", "h").distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h"))
    kept = rows.groupBy("top").agg(first.alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("h") == F.col("keep.h"))
    gone = shared(rows.join(kept, "top").where(~stays).select(F.col("doc_id").alias("_id"), F.col("h").alias("_text")))
    return without_rows(docs, gone, digest)
