"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text into vocabulary pieces is the one with the
largest sum of piece scores. A piece ends at most ``longest`` characters after it
begins, so only the boundaries of that window can still begin a piece. Whenever
the back pointers of all of them lead through one boundary, no future text can
change what lies before it: those ids are committed and forgotten.

Pieces that hold the word mark only at their front cannot cross the place before
a mark that follows other text, so every path goes through it: such stretches
are searched by themselves. A block of texts is cut into stretches by Arrow, and
each distinct stretch is searched once. Short stretches of one length go through
the search together, one character of all of them at a time; long ones, and those
with characters that are no pieces, stream one by one. Ids and decoded bytes are
then put together from those of the stretches and pieces.

Text is taken as it is (no normal form), with a mark in front and for each
blank. A character that no piece covers becomes its UTF-8 byte pieces; so does a
literal mark, so decoding gives back every text exactly. Of equal sums the
longer last piece wins. Null text counts as empty and has no ids. Repeated rows
have equal results; other columns are ignored; an empty table gives an empty
result. A very long text is a block by itself; of a long stretch only ids and
window are held, and the search for a common boundary waits until the window has
grown by half, so text without one (a long run of one letter) takes time in
proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.word_bpe import blocks, ranges

MARK = "▁"
NO_PIECE = "\ue000"
#: Characters that are read at least before the search looks for a common boundary again.
LOOK = 16
#: Stretches up to this length (with the mark) are searched together; stretches of one such search.
TOGETHER, WIDE = 40, 1 << 14
#: Bytes of text that are encoded together inside a task.
BLOCK_BYTES = 6 << 20
#: Odd multipliers of the hash of a piece, and of what spreads it over slots.
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The worker's vocabulary of a file, loaded once."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64))))


class Pieces:
    """Vocabulary of a model file: pieces with scores, byte pieces, and what decoding needs."""

    def __init__(self, path: str):
        known = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: known.is_control(i) or known.is_unknown(i) or known.is_unused(i)
        n = len(known)
        self.byte = {int(known.id_to_piece(i)[3:-1], 16): i for i in range(n) if known.is_byte(i)}
        self.score = {
            known.id_to_piece(i): (known.get_score(i), i) for i in range(n) if not special(i) and not known.is_byte(i)
        }
        self.score.pop(NO_PIECE, None)
        self.longest = max(map(len, self.score))
        # what pieces can end with: (score, ids) of a piece, None of a mere ending
        self.endings = dict.fromkeys(p[i:] for p in self.score for i in range(len(p)))
        self.endings |= {p: (s, (i,)) for p, (s, i) in self.score.items()}
        self.splits = all(MARK not in p.lstrip(MARK) for p in self.score)
        self.fallback = min(s for s, _ in self.score.values()) - 10
        text = {i: p.replace(MARK, " ").encode() for p, (_, i) in self.score.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.text = pa.array([text.get(i, b"") for i in range(n)], pa.large_binary())
        self._tables()

    def _tables(self) -> None:
        """Hashes of all pieces in order, with their scores and ids; a flag for each character that is a piece."""
        keys = {int(self._hash(p)): (s, i) for p, (s, i) in self.score.items()}
        if len(keys) < len(self.score):
            raise ValueError("two pieces share a hash")
        self.keys = np.array(sorted(keys), np.uint64)
        self.values = np.array([keys[k][0] for k in self.keys.tolist()] + [-math.inf])
        self.numbers = np.array([keys[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self.bits = 20
        slots = (self.keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.slot = np.searchsorted(slots, np.arange((1 << self.bits) + 1))
        self.deep = int(np.diff(self.slot).max())  # keys of the fullest slot
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in self.score if len(p) == 1]] = True

    def _hash(self, piece: str) -> np.uint64:
        codes = np.array([ord(c) + 1 for c in piece], np.uint64)
        return ((codes * _powers(len(codes) - 1)[::-1]).sum(dtype=np.uint64, keepdims=True) * _MIX)[0]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or the place behind them."""
        h = h * _MIX
        at = self.slot[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(h), len(self.keys))
        for step in range(self.deep):
            place = np.minimum(at + step, len(self.keys) - 1)
            out = np.where(self.keys[place] == h, place, out)
        return out

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]

    # ------------------------------------------------------------ whole blocks of texts
    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the len(texts) + 1 offsets."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = self._stretches(texts)
        first = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        ids, at = self.search_all(coded.dictionary)
        word = coded.indices.to_numpy()
        counts = np.diff(at)[word]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return ids[ranges(at[:-1][word], counts)], ends[first - first[0]]

    def _stretches(self, texts: pa.Array) -> pa.Array:
        """Lists of stretches: cut at blanks; a blank belongs to what follows it (the mark is put by the search)."""
        if not self.splits:
            return pa.array([[t] if t else [] for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        plain = pc.split_pattern(texts, " ")
        bare = pc.equal(pc.binary_length(plain.flatten()), 0).to_numpy(zero_copy_only=False)
        if not bare.any():
            return plain
        # blanks in a row, in front or behind, and empty texts
        first = plain.offsets.to_numpy().astype(np.int64)
        odd = np.add.reduceat(np.concatenate((bare, [False])), first[:-1] - first[0]).astype(bool)
        easy = iter(plain.filter(pa.array(~odd)).to_pylist())
        out = [_by_hand(text) if hard else next(easy) for text, hard in zip(texts.to_pylist(), odd.tolist(), strict=True)]
        return pa.array(out, pa.large_list(pa.large_string()))

    def search_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct stretches."""
        n = len(words)
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), words), pa.scalar("", words.type)).to_pylist()[0]
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        begin = np.cumsum(size) - size
        # a literal mark is no blank: it becomes a character that no piece has
        literal = (codes == ord(MARK)) | (codes == ord(NO_PIECE))
        odd = np.concatenate(([0], np.cumsum(literal)))
        codes = np.where(codes == 32, ord(MARK), codes)
        together = (size < TOGETHER) & (odd[begin + size] == odd[begin])
        counts, owners, parts = np.zeros(n, np.int64), [], []
        order = np.flatnonzero(together)
        order = order[np.argsort(size[order], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            for start in range(0, len(rows), WIDE):
                some = rows[start : start + WIDE]
                length = int(size[some[0]])
                text = np.column_stack((np.full(len(some), ord(MARK), np.uint32), codes[begin[some][:, None] + np.arange(length)]))
                ids, found = self._together(text)
                ids, found, right = self._spelling(ids, found, text)
                counts[some] = np.where(right, found, 0)
                owners.append(some[right])
                parts.append(ids)
                together[some[~right]] = False
        alone = {}
        for i in np.flatnonzero(~together).tolist():
            run = StreamingViterbi(self)
            alone[i] = run.feed(f" {words[i].as_py()}") + run.finish()
            counts[i] = len(alone[i])
        at = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(at[-1], np.int32)
        for rows, ids in zip(owners, parts, strict=True):
            out[ranges(at[rows], counts[rows])] = ids
        for i, ids in alone.items():
            out[at[i] : at[i + 1]] = ids
        return out, at

    def _together(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best ways of stretches of one length (rows of characters), and how many steps each has.

        A step is an id, or -1 minus a character that goes by its bytes.
        """
        n, width = text.shape
        power = _powers(width)
        head = np.zeros((width + 1, n), np.uint64)  # hash of the first characters
        for i in range(width):
            head[i + 1] = head[i] * _BASE + text[:, i].astype(np.uint64) + np.uint64(1)
        best = np.zeros((width + 1, n))
        back, way = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)
        for end in range(1, width + 1):
            top = np.full(n, -math.inf)
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                found = self._find(head[end] - head[start] * power[end - start])
                value = best[start] + self.values[found]
                better = np.flatnonzero((value >= top) & (found < len(self.keys)))
                top[better] = value[better]
                back[end, better] = start
                way[end, better] = self.numbers[found[better]]
            char = text[:, end - 1]
            by_bytes = np.flatnonzero(~self.single[char] & (best[end - 1] + self.fallback > top))
            top[by_bytes] = best[end - 1, by_bytes] + self.fallback
            back[end, by_bytes] = end - 1
            way[end, by_bytes] = -1 - char[by_bytes].astype(np.int32)
            best[end] = top
        steps, counts = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        at, rows = np.full(n, width), np.arange(n)
        while len(rows):
            steps[rows, counts[rows]] = way[at[rows], rows]
            counts[rows] += 1
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        turned = counts[:, None] - 1 - np.arange(width)
        return np.where(turned >= 0, np.take_along_axis(steps, np.maximum(turned, 0), 1), 0), counts

    def _spelling(self, steps: np.ndarray, counts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the rows that really spell their stretch one after another (a hash is no proof), their counts, and which those are."""
        flat = steps[np.arange(steps.shape[1]) < counts[:, None]]
        row = np.repeat(np.arange(len(steps)), counts)
        if (flat < 0).any():
            spelled = {v: self.bytes_of(chr(-1 - v)) for v in np.unique(flat[flat < 0]).tolist()}
            times = np.ones(len(flat), np.int64)
            for v, ids in spelled.items():
                times[flat == v] = len(ids)
            flat, row = np.repeat(flat, times), np.repeat(row, times)
            for v, ids in spelled.items():
                at = np.flatnonzero(flat == v)
                flat[at] = np.tile(np.array(ids, np.int32), len(at) // len(ids))
            counts = np.bincount(row, minlength=len(steps))
        got = self._joined(flat, np.concatenate(([0], np.cumsum(counts))))
        rows = np.where(text == ord(MARK), 32, text).astype("<u4")
        if b"".join(got.to_pylist()) == rows.tobytes().decode("utf-32-le").encode():
            return flat, counts, np.ones(len(steps), bool)
        right = np.array([g == r.tobytes().decode("utf-32-le").encode() for g, r in zip(got.to_pylist(), rows, strict=True)])
        return flat[right[row]], counts, right

    def _joined(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Bytes of each run of ids."""
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.text.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))

    def decode_block(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of runs of ids, from the ids alone."""
        whole = self._joined(ids, offsets)
        # without the blank of the first mark
        size = pc.binary_length(whole).to_numpy()
        starts = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
        keep = np.ones(len(data), bool)
        keep[(starts[:-1] - starts[0])[size > 0]] = False
        ends = np.concatenate(([0], np.cumsum(np.maximum(size - 1, 0))))
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[keep].tobytes())).cast(pa.string())

    # ------------------------------------------------------------ one text
    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return self.encode_block(pa.array([text], pa.large_string()))[0].astype("<i4").tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.decode_block(np.array(ids, np.int32), np.array([0, len(ids)])).to_pylist()[0]


def _by_hand(text: str) -> list[str]:
    """Stretches of a text with blanks in a row, in front or behind; none of an empty text."""
    if not text:
        return []
    out, run, parts = [], 0, text.split(" ")
    for i, part in enumerate(parts):
        if part or i == len(parts) - 1:
            out.append(" " * run + part)
            run = 0
        else:
            run += 1
    return out


class StreamingViterbi:
    """``feed`` text bit by bit: returns the ids that no later text can change; ``finish`` returns the rest.

    ``window`` is the largest number of characters that were held back.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.held = ""  # characters since the last committed boundary, blanks as marks
        self.best, self.back, self.ids = [0.0], [0], [()]
        self.window = 0

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(text):
            # an open window grows by half before it is looked at again
            size = max(LOOK, len(self.held) // 2)
            self._read(text[at : at + size])
            at += size
            self.window = max(self.window, len(self.held))
            if len(self.held) > self.pieces.longest:
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.held))
        self.held, self.best, self.back, self.ids = "", [0.0], [0], [()]
        return out

    def _read(self, text: str) -> None:
        look, fallback = self.pieces.endings.get, self.pieces.fallback
        best, back, ids = self.best, self.back, self.ids
        begin = len(self.held)
        # a literal mark is no blank: it becomes a character that no piece has
        self.held = held = self.held + text.replace(MARK, NO_PIECE).replace(" ", MARK)
        for end in range(begin + 1, len(held) + 1):
            start = last = end - 1
            top, origin, way = -math.inf, last, None
            found = look(held[last], 0)
            bare = not found
            while found != 0:  # 0: no piece ends like this, so no longer one does
                if found is not None:
                    value = best[start] + found[0]
                    if value >= top:
                        top, origin, way = value, start, found[1]
                if not start:
                    break
                start -= 1
                found = look(held[start:end], 0)
            if bare and best[last] + fallback > top:
                top, origin, way = best[last] + fallback, last, self.pieces.bytes_of(text[last - begin])
            best.append(top)
            back.append(origin)
            ids.append(way)

    def _commit(self) -> list[int]:
        n = len(self.held)
        alive = set(range(max(0, n - self.pieces.longest + 1), n + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last])
        boundary = alive.pop()
        if not boundary:
            return []
        out = self._path(boundary)
        low = self.best[boundary]
        self.held = self.held[boundary:]
        self.best = [x - low for x in self.best[boundary:]]
        self.back = [x - boundary for x in self.back[boundary:]]
        self.ids = self.ids[boundary:]
        self.back[0], self.ids[0] = 0, ()
        return out

    def _path(self, end: int) -> list[int]:
        parts = []
        while end:
            parts.append(self.ids[end])
            end = self.back[end]
        return [i for part in reversed(parts) for i in part]


def _ids(found: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for start, texts in blocks(batch.column("text"), BLOCK_BYTES):
                ids = batch.column("doc_id").slice(start, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, _ids(*own.encode_block(texts))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """The rows of (doc_id, ids) as (doc_id, text); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            lists = pc.if_else(batch.column("ids").is_valid(), batch.column("ids"), pa.scalar([], batch.column("ids").type))
            offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            texts = own.decode_block(lists.flatten().to_numpy(zero_copy_only=False), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), texts], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids, and the length and digest of the text that ``decoded`` gives back from the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for start, texts in blocks(batch.column("text"), BLOCK_BYTES):
                ids, offsets = own.encode_block(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)).cast(pa.int64()), _ids(ids, offsets), own.decode_block(ids, offsets)],
                    names=["doc_id", "ids", "decoded"],
                )

    both = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
        F.char_length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
