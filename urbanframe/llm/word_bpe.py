"""Exact, fast ids of a word-end BPE tokenizer file for whole texts.

The tokenizer drops white space, so the ids of a text are those of its chunks
between blanks. The distinct chunks of a block go through the merges together,
one numpy step per merge round; chunks that are not plain Latin letters with an
optional full stop or comma go to the tokenizer library itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Bytes of text that are encoded together inside a task.
BLOCK_BYTES = 2 << 20
#: A word with more bytes goes to the library.
LONGEST = 48
_NONE = np.int32(2**31 - 1)
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def blocks(texts: pa.Array, size: int = BLOCK_BYTES):
    """Slices (start, texts) of about ``size`` bytes; a longer text is a block by itself."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = held[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(held, before + size, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


class WordEncoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.tails = {ord(c): self.library.encode(c, add_special_tokens=False).ids[0] for c in ".,"}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (uint32), and the len(texts) + 1 offsets."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        first = chunks.offsets.to_numpy().astype(np.int64)
        words = chunks.flatten().dictionary_encode()
        ids, at = self._distinct(words.dictionary)
        word = words.indices.to_numpy()
        counts = np.diff(at)[word]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return ids[ranges(at[:-1][word], counts)], ends[first - first[0]]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct chunks."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        lo, hi = offsets[:-1], offsets[1:]
        data = np.concatenate((data[: hi[-1] if n else 0], [0]))
        begin, data = self._plain(data, lo, hi)
        size = hi - lo
        tail = np.where(size > 1, data[hi - 1], 0) * (size > 1)
        tail = np.where(np.isin(tail, list(self.tails)), tail, 0)
        stem = size - (tail > 0)
        bad = np.concatenate(([0], np.cumsum(~begin)))
        easy = (size > 0) & (stem <= LONGEST) & (bad[lo + stem] == bad[lo])
        counts, parts, owners = np.zeros(n, np.int64), [], []

        def put(rows: np.ndarray, ids: np.ndarray) -> None:
            counts[rows] = ids.shape[1]
            owners.append(rows)
            parts.append(ids)

        hard = np.flatnonzero(~easy & (size > 0))
        if len(hard):
            got = self.library.encode_batch_fast(words.take(pa.array(hard)).to_pylist(), add_special_tokens=False)
            got = [x.ids for x in got]
            counts[hard] = [len(x) for x in got]
        order = np.flatnonzero(easy)
        order = order[np.argsort(stem[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(stem[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            length = int(stem[rows[0]])
            raw = data[lo[rows][:, None] + np.arange(length)]
            for done, ids in self._merge(raw):
                done = rows[done]
                for t in (0, *self.tails):
                    if (own := tail[done] == t).any():
                        kept = ids[own]
                        put(done[own], np.column_stack((kept, np.full(len(kept), self.tails[t]))) if t else kept)
        at = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(at[-1], np.uint32)
        if len(hard):
            out[ranges(at[hard], counts[hard])] = [i for x in got for i in x]
        for rows, ids in zip(owners, parts, strict=True):
            if ids.shape[1]:
                out[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, at

    @staticmethod
    def _plain(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte whether it belongs to a Latin letter (A-Z and U+00C0-U+00FF), and the bytes in lower case."""
        upper = (data >= 65) & (data <= 90)
        letter = upper | ((data >= 97) & (data <= 122))
        lead = data == 0xC3
        second = np.concatenate(([False], lead[:-1]))
        other = second & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)  # not the signs for times, by
        first = lead & np.concatenate((other[1:], [False]))
        raised = upper | (other & (data <= 0x9E))
        return letter | other | first, np.where(raised, data + 32, data).astype(np.uint8)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], _NONE)

    def _merge(self, raw: np.ndarray):
        """Words of one length, a row of bytes each: yields (rows, ids) as rows finish.

        In each round every word does its leftmost merge of lowest rank.
        """
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        live = np.arange(len(raw))
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            width, n = rank.shape[1], len(live)
            if not width:
                yield live, ids
                return
            at = rank.argmin(1)
            low = rank[np.arange(n), at]
            more = low != _NONE
            if not more.all():
                yield live[~more], ids[~more]
                live, ids, rank, low, at = live[more], ids[more], rank[more], low[more], at[more]
                if not len(live):
                    return
            n, rows = len(live), np.arange(len(live))
            ids[rows, at] = self.made[low]
            keep = np.ones(ids.shape, bool)
            keep[rows, at + 1] = False  # every row gets one symbol and one pair shorter
            ids = ids[keep].reshape(n, width)
            keep = np.ones(rank.shape, bool)
            keep[rows, at] = False
            rank = rank[keep].reshape(n, width - 1)
            has = at < width - 1
            rank[rows[has], at[has]] = self._ranks(ids[rows[has], at[has]], ids[rows[has], at[has] + 1])
            has = at > 0
            rank[rows[has], at[has] - 1] = self._ranks(ids[rows[has], at[has] - 1], ids[rows[has], at[has]])
