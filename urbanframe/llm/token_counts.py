"""Edit-aware token counts: a segment tree of pre-tokens for each document.

Byte-level BPE never merges across pre-tokens, so a document's count is the sum
over its pre-tokens. These lie in small blocks, the leaves of a segment tree of
character and token sums. An edit descends to the first pre-token that could see
it, cuts pre-tokens from there until a boundary of the old text is met again,
replaces those leaves and updates the sums on the way up; all other pre-tokens
keep their counts.

The trees are kept: ``trees`` writes, for each document, the sizes of its
pre-tokens and the token sums of its leaves, as a table. ``counted`` reads it,
takes up the trees of edited documents only, from what was kept, and leaves all
others as they are. In a block of texts each distinct pre-token is merged once,
those of one length together.

A pre-token looks at two characters after its end at most (contractions), and at
nothing before its start, which bounds the context on both sides.

Null text counts as empty: no tokens. Edits of a document apply one after
another to the text as it then is; an edit outside the text is cut to it, and
null edits are none. Repeated rows have equal results; other columns are
ignored; ties do not arise. An empty table gives an empty result. A very long
text is a block by itself; its pre-tokens are held at once, some hundred bytes
for each.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.common import shared, text_blocks
from urbanframe.llm.word_bpe import LONGEST, WordEncoder, ranges

#: Pre-tokens of a leaf when the tree is built; a leaf of more than four times as many is split.
LEAF = 16
#: Pre-tokens a worker remembers while it edits.
REMEMBERED = 250_000
#: Characters of text handled at once inside a task.
BLOCK_CHARS = 3 << 20
#: Characters after its end that can decide about a pre-token.
AHEAD = 2
Edit = tuple[int, int, str]  # start, stop, replacement
_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file, loaded once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


class Counter(dict):
    """Token count of a pre-token, remembered; ``count_all`` counts many at once."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merges = ByteMerges(ranks)

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = n = len(self.library.encode_ordinary(token))
        return n

    def count_all(self, tokens: pa.Array) -> np.ndarray:
        """Token counts of distinct pre-tokens."""
        n = len(tokens)
        offsets = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + n + 1]
        data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
        size, out = np.diff(offsets), np.zeros(n, np.int64)
        order = np.flatnonzero((size > 0) & (size <= LONGEST))
        order = order[np.argsort(size[order], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            for done, ids in self.merges._merge(data[offsets[rows][:, None] + np.arange(int(size[rows[0]]))]):
                out[rows[done]] = ids.shape[1]
        for i in np.flatnonzero(size > LONGEST).tolist():
            out[i] = len(self.library.encode_ordinary(tokens[i].as_py()))
        return out


class ByteMerges(WordEncoder):
    """The merge rounds of ``WordEncoder`` for a byte-level vocabulary, where a merge ranks like the token it makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.inner = self.last = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(rank)
        keys, made = np.array(keys, np.int64), np.array(made, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], made[order].astype(np.int32)
        self.made = np.arange(self.size)  # a rank is the id of what it makes


class SegmentTree:
    """Pre-tokens of one text in leaves, with sums of characters and tokens above them."""

    def __init__(self, text: str, counts: Counter, sizes: list[int] | None = None, sums: list[int] | None = None):
        """A tree built from the text, or taken up from the kept sizes of its pre-tokens and token sums of its leaves."""
        self.counts, self.recoded = counts, 0
        if sizes is None:
            tokens = counts.pattern.findall(text)
        else:
            tokens, at = [], 0
            for n in sizes:
                tokens.append(text[at : at + n])
                at += n
        self.leaves = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self._build(sums)

    def _build(self, sums: list[int] | None = None) -> None:
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            if sums:
                self.chars[self.width + i], self.tokens[self.width + i] = sum(map(len, leaf)), sums[i]
            else:
                self._sum(i, leaf)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _sum(self, leaf: int, tokens: list[str]) -> None:
        self.chars[self.width + leaf] = sum(map(len, tokens))
        self.tokens[self.width + leaf] = sum(map(self.counts.__getitem__, tokens))

    def _update(self, leaf: int) -> None:
        self._sum(leaf, self.leaves[leaf])
        i = (self.width + leaf) // 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t in leaf)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character ``place``; the last leaf beyond the end."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if place >= begin + self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.width, begin

    def _stretch(self, start: int, stop: int) -> tuple[int, int, int, list[str]]:
        """Leaves (first, last) that hold the characters from start to stop, the first one's begin, and their pre-tokens."""
        first, begin = self._leaf_at(start)
        last, _ = self._leaf_at(max(start, stop - 1))
        return first, last, begin, [t for leaf in self.leaves[first : last + 1] for t in leaf]

    def edit(self, start: int, stop: int, new: str) -> None:
        start = min(max(0, start), self.length)
        stop = min(max(start, stop), self.length)
        if start == stop and not new:
            return
        reach = LEAF  # characters after the edit that are looked at; doubled until a boundary is met again
        first, last, begin, tokens = self._stretch(max(0, start - AHEAD - 1), min(self.length, stop + reach))
        ends, at = [], begin
        for t in tokens:
            at += len(t)
            ends.append(at)
        left = bisect_right(ends, start - AHEAD)  # pre-tokens before this one cannot see the edit
        while left == 0 and first > 0 and start - AHEAD < begin:  # the stretch begins inside the context
            first -= 1
            begin -= self.chars[self.width + first]
            tokens = self.leaves[first] + tokens
            ends, at = [], begin
            for t in tokens:
                at += len(t)
                ends.append(at)
            left = bisect_right(ends, start - AHEAD)
        cut = ends[left - 1] if left else begin
        shift = len(new) - (stop - start)
        while True:
            end = begin + sum(map(len, tokens))
            final = end == self.length
            old = "".join(tokens)
            text = old[cut - begin : start - begin] + new + old[stop - begin :]
            old_ends = {e: i + 1 for i, e in enumerate(ends) if e >= stop}
            fresh, at, meets = [], cut, None
            for m in self.counts.pattern.finditer(text):
                # a pre-token that could see beyond the stretch is only sure at the end of the document
                if not final and cut + m.end() + AHEAD > end + shift:
                    break
                fresh.append(m.group())
                at = cut + m.end()
                if at - shift in old_ends and at >= start + len(new):
                    meets = old_ends[at - shift]
                    break
            if meets is None and final and at == end + shift:
                meets = len(tokens)
            if meets is not None:
                break
            last, grow = self._more(last, reach)
            reach *= 2
            tokens = tokens + grow
            at = ends[-1] if ends else begin
            for t in grow:
                at += len(t)
                ends.append(at)
        self.recoded += len(fresh)
        self._replace(first, last, tokens[:left] + fresh + tokens[meets:])

    def _more(self, last: int, chars: int) -> tuple[int, list[str]]:
        out: list[str] = []
        while last + 1 < len(self.leaves) and chars > 0:
            last += 1
            out += self.leaves[last]
            chars -= self.chars[self.width + last]
        return last, out

    def _replace(self, first: int, last: int, tokens: list[str]) -> None:
        """Deal the pre-tokens over the leaves; a leaf that gets too many splits, and the tree is built anew."""
        leaves = last - first + 1
        size = -(-len(tokens) // leaves) if tokens else 1
        if size > 4 * LEAF:
            self.leaves[first : last + 1] = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)]
            self._build()
            return
        for k in range(leaves):
            self.leaves[first + k] = tokens[k * size : (k + 1) * size]
            self._update(first + k)


EDITS = "array<struct<start: long, stop: long, text: string>>"


def trees(docs: DataFrame, path: str, edits: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """The tree of every document: doc_id, n_tokens, n_chars, sizes of pre-tokens, sums of leaves, and its edits.

    Edits come from the column ``edits`` (array of struct start, stop, text) or,
    where a rule ``edits`` is given, from each text. The text itself is carried
    on only where there are edits.
    """
    given = edits is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        cut = counts.pattern.findall
        for batch, texts in text_blocks(batches, chars=BLOCK_CHARS):
            lists = [cut(x) for x in texts]
            coded = pa.array([t for own in lists for t in own], pa.large_string()).dictionary_encode()
            word = coded.indices.to_numpy()
            tokens = counts.count_all(coded.dictionary)[word]
            sizes = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int32)[word]
            many = np.array([len(own) for own in lists], np.int64)
            ends = np.concatenate(([0], np.cumsum(many)))
            leaves = -(-many // LEAF)
            heads = np.repeat(ends[:-1], leaves) + LEAF * ranges(np.zeros(len(many), np.int64), leaves)
            sums = np.add.reduceat(tokens, heads) if len(heads) else np.zeros(0, np.int64)
            leaf_ends = np.concatenate(([0], np.cumsum(leaves)))
            whole = np.concatenate(([0], np.cumsum(tokens)))
            todo = batch.column("edits").to_pylist() if given else [[{"start": a, "stop": b, "text": t} for a, b, t in edits(x)] for x in texts]
            todo = [[e for e in own or [] if e is not None] for own in todo]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(whole[ends[1:]] - whole[ends[:-1]], pa.int64()),
                    pa.array([len(x) for x in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sizes, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(leaf_ends, pa.int32()), pa.array(sums, pa.int32())),
                    pa.array([own or None for own in todo], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())]))),
                    pa.array([x if own else None for x, own in zip(texts, todo, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_tokens", "n_chars", "sizes", "sums", "edits", "text"],
            )

    source = docs.select("doc_id", "text", *([F.col("edits").cast(EDITS)] if given else []))
    return source.mapInArrow(run, f"doc_id long, n_tokens long, n_chars long, sizes array<int>, sums array<int>, edits {EDITS}, text string")


def _edited(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trees taken up as kept, with their edits applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                tree = SegmentTree(r["text"], counts, r["sizes"], r["sums"])
                for e in r["edits"]:
                    tree.edit(e["start"], e["stop"], e["text"] or "")
                rows.append((r["doc_id"], r["n_tokens"], len(r["edits"]), tree.count, tree.recoded, tree.length))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns],
                names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_recoded", "n_chars_edited"],
            )

    return run


def counted(docs: DataFrame, path: str, edits: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_recoded, n_chars_edited of every document.

    ``n_recoded`` counts the pre-tokens that were cut again; a document without
    edits keeps its counts and is not looked at again.
    """
    kept = shared(trees(docs, path, edits))
    same = kept.where("edits IS NULL").select(
        "doc_id", "n_tokens", F.lit(0).cast("long").alias("n_edits"), F.col("n_tokens").alias("n_tokens_edited"),
        F.lit(0).cast("long").alias("n_recoded"), F.col("n_chars").alias("n_chars_edited"),
    )
    changed = kept.where("edits IS NOT NULL").select("doc_id", "n_tokens", "sizes", "sums", "edits", "text").mapInArrow(
        _edited(path), "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_recoded long, n_chars_edited long"
    )
    return same.union(changed)


# What the scrubbing rule replaces.
_SCRUB = regex.compile(r"(?P<mail>[^\s@]+@[^\s@]+\.[^\s@]+)|(?P<number>\d{5,})|(?P<signs>([!#$%&*=~-])\4{2,})")
# What a text must hold for the rule to find anything but the end.
_NUMBER, _SIGNS = re.compile(r"\d{5}"), re.compile(r"([!#$%&*=~-])\1\1")


def scrubbing(text: str) -> list[Edit]:
    """Edits of a usual cleaning step: addresses and long numbers masked, runs of one sign cut to one, the end trimmed.

    Listed from the last to the first, so that places are those of the text itself.
    """
    found = []
    for m in _SCRUB.finditer(text) if "@" in text or _NUMBER.search(text) or _SIGNS.search(text) else ():
        new = "<mail>" if m["mail"] else "<number>" if m["number"] else m["signs"][0]
        found.append((m.start(), m.end(), new))
    end = len(text.rstrip())
    if end < len(text):
        found = [e for e in found if e[1] <= end] + [(end, len(text), "")]
    return found[::-1]
