"""Repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A window is a run of ``length`` bytes. Equal windows have the same smallest
hashed gram at the same place (their anchor), so every document is cut into
segments of consecutive windows with one anchor, and segments meet under the
hash of their anchor gram:

1. Segments of one anchor are sorted by content digest and place. Equal segments
   are one entry with its earliest place (copies travel on as places only);
   anchors that occur once need nothing more.
2. The entries' bytes are fetched, and tasks build the transform of some
   megabytes of whole anchors each. Intervals of suffixes are extended to the
   left breadth first, so common prefixes come out by increasing value, up to
   ``length``; what is then still undivided are the classes of equal windows.
   In each class all places but the earliest are repeats.
3. An anchor with very many different surroundings (a line that a third of all
   documents share) is cut into its single windows, which meet under a 128-bit
   digest of their content and so spread over all tasks.
4. Repeats of a document are put together and cut out.

Texts are UTF-8 bytes; null is empty. Places are ordered by (doc_id, start);
windows never cross documents. Rows that repeat an id with the same text are one
document and each keep the same rest; with another text they are told apart by
a tag of the text. Rows without an id are returned whole. Documents shorter than
``length`` keep everything. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.common import shared
from urbanframe.llm.word_bpe import blocks, ranges

LENGTH = 100
#: Bytes of a gram; an anchor is the smallest of LENGTH - GRAM + 1 grams.
GRAM = 20
#: Entries of an anchor; more are cut into single windows.
CROWDED = 4096
#: Bytes of segments in one transform (a larger anchor is one by itself), and of text that is cut into segments at once.
TRANSFORM_BYTES, BLOCK = 1 << 19, 1 << 19
#: Contents whose earliest place a task remembers.
SEEN = 200_000
#: A longer document is cut into segments piece by piece.
PIECE = 1 << 24

_BASE = 0x9E3779B97F4A7C15
_TURN, _FAR = np.uint64(0xD6E8FEB86659FD93), np.uint64(26)
_TAGS = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _TURN
    x = (x ^ (x >> np.uint64(32))) * _TURN
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            step = lambda b: np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64))))
            self.up, self.down = step(self.base), step(pow(self.base, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(_BASE), _Powers(0xC2B2AE3D27D4EB4F)]


class Digests:
    """Polynomial digests of any ranges of some bytes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, down = _POWERS[which].upto(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]


def cut_segments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """(key, same, start, windows) of the segments of the documents data[bounds[i]:bounds[i + 1]]."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    valid = ranges(bounds[:-1], counts)
    if not len(valid):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    digests = Digests(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    grams = _mixed(digests.of(at, at + gram))
    low = ((grams >> _FAR) << _FAR) | at.astype(np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: n - width + 1], low[width - size : n - size + 1])
    anchor = (low[valid] & np.uint64((1 << 26) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))))
    windows = np.diff(np.append(first, len(valid)))
    start = valid[first]
    same = _mixed(digests.of(start, start + windows + length - 1) ^ windows.astype(np.uint64))
    return grams[anchor[first]], same, start, windows


def _tag() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(_TAGS))


def place(tag, start, windows):
    """One number for tag, start and windows; in the order of start within a document."""
    return (tag << 48) | (start << 8) | windows


def unplace(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 48, (at >> 8) & ((1 << 40) - 1), at & 255


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its members."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Seen:
    """Earliest place a task has met of each content; a later place is known to be a copy before the shuffle.

    So a content that a third of all documents share sends a few rows of each
    task to its key, and the copies go anywhere.
    """

    def __init__(self):
        self.first: dict[int, tuple[int, int]] = {}

    def rows(self, key: np.ndarray, same: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        content = (key ^ ((same << np.uint64(1)) | (same >> np.uint64(63)))).tolist()
        first, keep, copy = self.first, np.ones(len(key), bool), np.zeros(len(key), bool)
        for i, (x, place) in enumerate(zip(content, zip(doc.tolist(), at.tolist(), strict=True), strict=True)):
            before = first.get(x)
            if before is None or place < before:
                first[x] = place
            elif place == before:
                keep[i] = False
            else:
                copy[i] = True
        if len(first) > SEEN:
            first.clear()
        key = np.where(copy, _mixed(doc.astype(np.uint64) ^ (at.astype(np.uint64) << np.uint64(20))), key)
        columns = [pa.array(copy[keep]), *(pa.array(x[keep].view(np.int64)) for x in (key, same, doc, at))]
        return pa.RecordBatch.from_arrays(columns, names=["copy", "key", "same", "doc_id", "at"])


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """copy, key, same, doc_id, at of all segments of documents (doc_id, text, tag)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            for first, texts in blocks(batch.column("text"), BLOCK):
                data, bounds = _bytes(texts)
                for lo in range(0, max(1, len(data) - length + 1), PIECE):  # one round but for very long texts
                    hi = min(len(data), lo + PIECE + length - 1)
                    own = np.clip(bounds, lo, hi) - lo
                    key, same, start, windows = cut_segments(data[lo:hi], own, length, gram)
                    doc = np.searchsorted(bounds, start + lo, side="right") - 1
                    at = place(tags[first + doc], start + lo - bounds[doc], windows)
                    yield seen.rows(key, same, ids[first + doc], at)

    return docs.mapInArrow(cut, "copy boolean, key long, same long, doc_id long, at long")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (copy, key, same, doc_id, at): the earliest of equal segments as an entry, the others as copies.

    Entries of a key without any other row are dropped, and so is a place that
    comes twice. Only the last row is carried from batch to batch.
    """
    names = ["key", "same", "doc_id", "at"]
    held, before = None, None
    for batch in batches:
        known = batch.column("copy")
        if pc.any(known).as_py():
            yield batch.filter(known).select(["key", "doc_id", "at"]).add_column(0, "entry", pa.array([False] * known.true_count))
            batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
        new = [batch.column(c).to_numpy() for c in names]
        rows = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        yield from _classes([x[:-1] for x in rows], before, [x[-1] for x in rows])
        if len(rows[0]) > 1:
            before = [x[-2] for x in rows]
        held = [x[-1:] for x in rows]
    if held is not None:
        yield from _classes(held, before, None)


def _classes(rows: list[np.ndarray], before: list | None, after: list | None) -> Iterator[pa.RecordBatch]:
    key, same, doc, at = rows
    if not len(key):
        return

    def as_before(*columns: int) -> np.ndarray:
        """Whether a row agrees with the one before it."""
        out = np.ones(len(key), bool)
        for c in columns:
            x = rows[c]
            out[1:] &= x[1:] == x[:-1]
            out[0] &= before is not None and x[0] == before[c]
        return out

    key_goes_on = as_before(0)
    next_is_same = np.append(key_goes_on[1:], after is not None and after[0] == key[-1])
    equal = as_before(0, 1)
    twice = equal & as_before(2, 3)
    entry = ~equal & (key_goes_on | next_is_same)
    for kind, own in (("entry", entry), ("copy", equal & ~twice)):
        if own.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind == "entry"] * int(own.sum())), pa.array(key[own]), pa.array(doc[own]), pa.array(at[own])],
                names=["entry", "key", "doc_id", "at"],
            )


def equal_windows(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a cyclic text (symbols below 512), and for each place in it whether a class of suffixes begins.

    Suffixes of one class agree in their first ``length`` symbols.
    """
    n = len(symbols)
    wrapped = np.concatenate((symbols, np.resize(symbols, 7))).astype(np.int64)
    rank = np.zeros(n, np.int64)
    for j in range(7):
        rank = (rank << 9) | wrapped[j : n + j]
    order = np.argsort(rank, kind="stable")
    fresh = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    depth = 7
    slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while depth < length and len(slots):  # prefix doubling, only where suffixes still agree
        own = order[slots]
        pair = rank[own] * n + rank[(own + depth) % n]
        turn = np.argsort(pair, kind="stable")
        own, pair = own[turn], pair[turn]
        order[slots] = own
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[own] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    last = symbols[order - 1]  # the transform
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)  # from a place of the transform to the suffix one symbol longer
    step[by_symbol] = np.arange(n)
    grouped = last[by_symbol]
    more = grouped[1:] == grouped[:-1]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[by_symbol[:-1][more]] = by_symbol[1:][more]
    preceding[by_symbol[1:][more]] = by_symbol[:-1][more]
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):  # all strings of 1, 2, ... symbols whose right border is new
        size = high - low
        own = ranges(low, size)
        new_low = np.sort(step[own[preceding[own] < np.repeat(low, size)]])
        new_high = np.sort(step[own[following[own] >= np.repeat(high, size)]]) + 1
        new = ~border[new_high]
        low, high = new_low[new], new_high[new]
        if not len(low):
            break
        border[high] = True
    return order, border[:n]


def repeats(texts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that a segment before it, or an earlier place of it, has too.

    ``texts`` come in the order of their places.
    """
    data, bounds = _bytes(pa.array(texts, pa.large_binary()))
    size = np.diff(bounds)
    begin = bounds[:-1] + np.arange(len(texts))  # a separator follows each segment
    symbols = np.zeros(len(data) + len(texts), np.uint16)
    symbols[ranges(begin, size)] = data.astype(np.uint16) + 1
    order, border = equal_windows(symbols, length)
    is_window = np.zeros(len(symbols), bool)
    starts = ranges(begin, windows)
    is_window[starts] = True
    at = is_window[order]
    kind, own = np.cumsum(border)[at], order[at]
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    earliest = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
    later = np.sort(own[own != earliest])
    segment = np.searchsorted(begin, later, side="right") - 1
    return segment, later - begin[segment]


def _transform(length: int):
    """Rows (key, doc_id, at, bytes) sorted by key -> places (doc_id, at) of repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            if held and held[-1].column("key")[-1].as_py() != keys[0] and size >= TRANSFORM_BYTES:
                yield from found(held)
                held, size = [], 0
            start = 0
            sizes = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False))
            while start < len(keys):
                before = sizes[start - 1] if start else 0
                stop = int(np.searchsorted(sizes, before + TRANSFORM_BYTES - size, side="left")) + 1
                stop = int(ends[min(np.searchsorted(ends, stop, side="left"), len(ends) - 1)])
                held.append(batch.slice(start, stop - start))
                size += int(sizes[stop - 1] - before)
                if size >= TRANSFORM_BYTES and stop < len(keys):
                    yield from found(held)
                    held, size = [], 0
                start = stop
        if held:
            yield from found(held)

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        doc, at = table["doc_id"].to_numpy(), table["at"].to_numpy()
        order = np.lexsort((at, doc))
        doc, at, texts = doc[order], at[order], table["bytes"].take(pa.array(order)).to_pylist()
        again = np.append(False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]))
        for i in np.flatnonzero(again).tolist():
            again[i] = texts[i] == texts[i - 1]
        if again.any():  # a repeated row brings its segments once more; they are the same place
            doc, at, texts = doc[~again], at[~again], [x for x, drop in zip(texts, again.tolist(), strict=True) if not drop]
        tag, start, windows = unplace(at)
        segment, window = repeats(texts, windows, length)
        if not len(segment):
            return
        first = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1))))
        many, segment, window = np.diff(np.append(first, len(segment))), segment[first], window[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[segment]), pa.array(place(tag[segment], start[segment] + window, many))], names=["doc_id", "at"]
        )

    return run


def _fetch(length: int):
    """Documents with their entries -> the entries' bytes, or for crowded anchors the digests of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for first, texts in blocks(batch.column("text"), BLOCK):
                data, bounds = _bytes(texts)
                lists = batch.column("entries").slice(first, len(texts))
                inner = lists.flatten()
                doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                at, key, crowded = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                ids = batch.column("doc_id").slice(first, len(texts)).to_numpy()
                tag, start, windows = unplace(at)
                start = bounds[doc] + start
                plain = np.flatnonzero(~crowded)
                held = data.tobytes()
                ends = start + windows + length - 1
                cut = [held[a:b] for a, b in zip(start[plain].tolist(), ends[plain].tolist(), strict=True)]
                n = len(plain)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.bool_()), pa.array(key[plain]), pa.nulls(n, pa.int64()), pa.array(ids[doc[plain]]), pa.array(at[plain]), pa.array(cut, pa.binary())],
                    names=["copy", "key", "same", "doc_id", "at", "bytes"],
                )
                if n < len(key):
                    other = np.flatnonzero(crowded)
                    single = ranges(start[other], windows[other])
                    owner = np.repeat(other, windows[other])
                    one, two = (_mixed(Digests(data, i).of(single, single + length)) for i in range(2))
                    where = place(tag[owner], single - bounds[doc[owner]], np.int64(1))
                    rows = seen.rows(one, two, ids[doc[owner]], where)
                    yield rows.append_column("bytes", pa.nulls(rows.num_rows, pa.binary()))

    return run


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """doc_id, tag, places: for each document with repeats, the list of places (start, windows packed by ``place``)."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _tag().alias("tag"))
    by_content = ["copy", "key", "same", "doc_id", "at"]
    rows = segments(texts, length, gram).repartition("key").sortWithinPartitions(*by_content)
    known = shared(rows.mapInArrow(_collapse, "entry boolean, key long, doc_id long, at long"), tidy=True)
    entries = known.where("entry").select("key", "doc_id", "at")
    many = shared(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key", F.lit(True).alias("crowded")), tidy=True)
    entries = entries.join(many, "key", "left").select("doc_id", F.struct("at", "key", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("e"))
    tag = lambda c: F.shiftright(c, 48)
    lists = entries.groupBy("doc_id", tag(F.col("e.at")).alias("tag")).agg(F.collect_list("e").alias("entries"))
    fetched = texts.join(lists, ["doc_id", "tag"]).select("doc_id", "text", "entries")
    fetched = shared(fetched.mapInArrow(_fetch(length), "copy boolean, key long, same long, doc_id long, at long, bytes binary"), tidy=True)
    plain = fetched.where("same is null").select("key", "doc_id", "at", "bytes").repartition("key").sortWithinPartitions("key")
    found = plain.mapInArrow(_transform(length), "doc_id long, at long")
    single = fetched.where("same is not null").select(*by_content).repartition("key").sortWithinPartitions(*by_content)
    single = single.mapInArrow(_collapse, "entry boolean, key long, doc_id long, at long").where("not entry")
    places = known.where("not entry").select("doc_id", "at").union(found).union(single.select("doc_id", "at"))
    return shared(places.groupBy("doc_id", tag(F.col("at")).alias("tag")).agg(F.collect_list("at").alias("places")), tidy=True)


def covered(places: list[int] | np.ndarray | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of bytes that the windows at these places cover."""
    if places is None or not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, start, windows = unplace(np.sort(np.asarray(places, np.int64)))
    end = np.maximum.accumulate(start + windows + length - 1)
    first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return start[first], end[np.append(first[1:] - 1, len(end) - 1)]


def _without(data: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    at = [0, *(x for pair in zip(start.tolist(), end.tolist(), strict=True) for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def whole_characters(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without characters that they cover only in part."""
    a, b = start.tolist(), end.tolist()
    for i in range(len(a)):
        while a[i] < b[i] and data[a[i]] & 0xC0 == 0x80:
            a[i] += 1
        while b[i] > a[i] and b[i] < len(data) and data[b[i]] & 0xC0 == 0x80:
            b[i] -= 1
    return np.array(a, np.int64), np.array(b, np.int64)


def _with_places(docs: DataFrame, length: int, **x) -> DataFrame:
    """The documents with their list ``places``; id and tag are compared under names of their own."""
    found = repeated(docs, length, **x).select(F.col("doc_id").alias("_doc_id_"), F.col("tag").alias("_tag_"), F.col("places").alias("_places_"))
    same = (F.col("doc_id").cast("long") == F.col("_doc_id_")) & (_tag() == F.col("_tag_"))
    return docs.join(found, same, "left").select(*(docs[c] for c in docs.columns), "_places_")


def measured(docs: DataFrame, length: int = LENGTH, **x) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column("text"), batch.column("_places_"), strict=True):
                data = (text.as_py() or "").encode()
                start, end = covered(places.values.to_numpy() if places.is_valid else None, length)
                kept = _without(data, start, end)
                rows.append((len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = _with_places(docs.select("doc_id", "text"), length, **x)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep_first(docs: DataFrame, length: int = LENGTH, **x) -> DataFrame:
    """The documents without their repeated passages (whole characters only); n_chars follows, other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, places in zip(batch.column("text"), batch.column("_places_"), strict=True):
                if not places.is_valid:
                    texts.append(text.as_py())
                    continue
                data = text.as_py().encode()
                texts.append(_without(data, *whole_characters(data, *covered(places.values.to_numpy(), length))).decode())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type)).drop_columns(["_places_"])

    rows = _with_places(docs, length, **x)
    out = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out.select(*docs.columns)
