"""Spelling variants: the vocabulary acceptor, a one-edit transducer and the acceptor again, composed.

1. Words. A task turns every whole text into letter runs and counts them in
   blocks; Spark adds the counts up.
2. Initial states. Two words of ``m`` and at most ``m + 1`` code points that are
   one edit apart agree before and behind a window that holds the edit. Each
   word enters the halves ``[0, m/2)`` and ``[m/2, m)`` for its own length and
   for one less; the agreeing rest (the context) leads to one initial state of
   the composed machine. A state with more than ``limit`` words, or a window
   above ``WINDOW`` code points, is cut into its two half windows until it fits,
   so a prefix that a third of all words share spreads over many states. A
   context that only one word has leaves at once.
3. Composition. A task gets all words of an initial state, builds the minimised
   acceptor of their windows and composes it with the edit transducer and
   itself. Words are numbered by their rank along the paths (each arc knows how
   many words pass before it), so accepted pairs are pairs of ranks; results of
   equal state pairs are remembered. The edit stands at the first place where
   the words differ, so each pair is accepted in one window and length only.
4. Forms and roots: the near word of largest count, then pointer doubling.

Null texts have no words; rows without ``doc_id`` count with an empty id in the
damage rule; repeated rows count again; other columns are ignored. An empty
table gives an empty result. Very long texts are read in pieces cut between
words. A word list must hold each word once (``near_words`` adds up repeats and
leaves out null and empty words). A window of one code point cannot be cut
further: its state holds at most as many words as the alphabet has letters, plus
the square of that for the words that are one longer.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.llm.common import shared, text_blocks

#: Words of an initial state before its window is cut, longest window, counts held in a task, bytes of text split at once.
LIMIT, WINDOW, HELD, PIECE = 4096, 32, 200_000, 1 << 20

#: Latin-1 letters A-Z, a-z and U+00C0 to U+00FF; A-Z become lower case, the rest separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _runs(text: str) -> Iterator[list[bytes]]:
    """Lower-cased letter runs of a text, one byte a code point, in pieces."""
    data = text.encode("latin-1", "replace").translate(LETTERS)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _damaged(run: bytes, seed: int, every: int) -> bytes:
    """The run, or the run without one code point if ``every`` divides the crc32 of id and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, least: int = 5, shortest: int = 6, damage: int | None = None) -> DataFrame:
    """(word, n): letter runs of ``shortest`` code points or more that occur ``least`` times or more.

    With ``damage``, every occurrence whose crc32 of ``<doc_id>:<run>`` it
    divides loses one code point first (planted misspellings).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.record_batch({"word": [w.decode("latin-1") for w in held], "n": pa.array(held.values(), pa.int64())})

        held: Counter = Counter()
        for block, texts in text_blocks(batches):
            for i, text in zip(block.column("doc_id").to_pylist(), texts):
                seed = zlib.crc32(b"%s:" % ("" if i is None else str(i)).encode())
                for piece in _runs(text):
                    for run, k in Counter(piece).items():
                        if len(run) >= shortest:
                            if damage:
                                run = _damaged(run, seed, damage)
                                if len(run) < shortest:
                                    continue
                            held[run] += k
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---------------------------------------------------------------- initial states of the composed machine
def _keyed(rows: DataFrame) -> DataFrame:
    """``key`` of the context: what stands before and behind the window. Equal keys are told apart by text later."""
    behind = F.expr("substring(word, length(word) - (m - hi) + 1, m - hi)")
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", F.expr("substring(word, 1, lo)"), behind))


def initial_states(words: DataFrame, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """word, n, m, lo, hi, key: every word in each initial state it shares with another word."""
    rows = words.select("word", "n", F.expr("explode(array(length(word), length(word) - 1))").alias("m")).where("m >= 1")
    halves = "explode(filter(array(struct(lo, mid AS hi), struct(mid AS lo, hi)), x -> x.lo < x.hi))"
    cut = lambda df: df.withColumn("mid", F.expr("int((lo + hi) div 2)")).withColumn("w", F.expr(halves)).select(
        "word", "n", "m", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")
    )
    rows = cut(rows.withColumns({"lo": F.lit(0), "hi": F.col("m")}))
    done = None
    while True:
        rows = shared(_keyed(rows))
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.expr("length(word) = m")).alias("short"))
        rows = rows.join(sizes.where("size > 1 AND short"), "key")
        fits = F.expr(f"hi - lo = 1 OR (size <= {limit} AND hi - lo <= {window})")
        rows = shared(rows.select("word", "n", "m", "lo", "hi", "key", fits.alias("fits")))
        found = rows.where("fits").drop("fits")
        done = found if done is None else done.union(found)
        rows = rows.where("NOT fits")
        if rows.isEmpty():
            return done
        rows = cut(rows)


# ---------------------------------------------------------------- acceptor and composition inside one initial state
class Acceptor:
    """Minimised acyclic acceptor of sorted, distinct words; states are numbers, words are ranks."""

    def __init__(self, words: list[str]):
        self.words, self.register = words, {}
        #: Of each state: does it accept, its arcs symbol -> (target, words before), words accepted from it.
        self.final, self.arcs, self.size = [], [], []
        self.start = self._state(0, len(words), 0)

    def _state(self, first: int, last: int, depth: int) -> int:
        """State after the ``depth`` code points that the words ``first`` to ``last`` share; equal states are one."""
        words, final, signature = self.words, False, []
        if len(words[first]) == depth:
            final, first = True, first + 1
        while first < last:
            symbol, end = words[first][depth], first + 1
            while end < last and words[end][depth] == symbol:
                end += 1
            signature.append((symbol, self._state(first, end, depth + 1)))
            first = end
        known = (final, *signature)
        state = self.register.get(known)
        if state is None:
            state = self.register[known] = len(self.final)
            arcs, before = {}, int(final)
            for symbol, target in signature:
                arcs[symbol] = (target, before)
                before += self.size[target]
            self.final.append(final)
            self.arcs.append(arcs)
            self.size.append(before)
        return state


class Composition:
    """Acceptor, one edit, acceptor: the accepted pairs of different words as pairs of ranks.

    ``at_end``: the words end with the window, so the longer one may have its
    extra code point last.
    """

    def __init__(self, acceptor: Acceptor, at_end: bool):
        self.a, self.at_end, self.same, self.edited = acceptor, at_end, {}, {}

    def pairs(self) -> list[tuple[int, int]]:
        return self._before(self.a.start)

    def _before(self, q: int) -> list[tuple[int, int]]:
        """Pairs accepted from (q, no edit yet, q): read on, replace, or delete on the left side."""
        found = self.edited.get(q)
        if found is None:
            found = self.edited[q] = []
            arcs = list(self.a.arcs[q].items())
            for i, (symbol, (to, add)) in enumerate(arcs):
                found += [(add + x, add + y) for x, y in self._before(to)]
                for _, (other, more) in arcs[i + 1 :]:
                    found += [(add + x, more + y) for x, y in self._after(to, other)]
                found += [(add + x, y) for x, y in self._shorter(to, q, symbol)]
        return found

    def _after(self, p: int, q: int) -> list[tuple[int, int]]:
        """Pairs accepted from (p, edit done, q): both sides read the same."""
        if p == q:
            return [(i, i) for i in range(self.a.size[p])]
        found = self.same.get((p, q))
        if found is None:
            found = self.same[p, q] = [(0, 0)] if self.a.final[p] and self.a.final[q] else []
            found += self._on(p, q, None)
        return found

    def _shorter(self, p: int, q: int, symbol: str) -> list[tuple[int, int]]:
        """After deleting ``symbol``: what follows must not start with it, or the words differ further on."""
        empty = self.at_end and self.a.final[p] and self.a.final[q]
        return ([(0, 0)] if empty else []) + self._on(p, q, symbol)

    def _on(self, p: int, q: int, but: str | None) -> list[tuple[int, int]]:
        left, right, found = self.a.arcs[p], self.a.arcs[q], []
        for symbol in left.keys() & right.keys() if len(left) < len(right) else right.keys() & left.keys():
            if symbol != but:
                (to, add), (other, more) = left[symbol], right[symbol]
                found += [(add + x, more + y) for x, y in self._after(to, other)]
        return found


def near_in_state(words: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """Pairs of the words, which share all but their windows, that are one edit apart; the shorter has ``m`` code points."""
    back = m - hi
    by_window = {w[lo : len(w) - back]: w for w in words}
    windows = sorted(by_window)
    for x, y in Composition(Acceptor(windows), hi == m).pairs():
        if len(windows[x]) == hi - lo or len(windows[y]) == hi - lo:
            yield by_window[windows[x]], by_window[windows[y]]


NEAR = pa.list_(pa.struct([("n", pa.int64()), ("word", pa.string())]))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in, each word's near words of one initial state out."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "m", "lo", "hi", "word", "n")))

    out: list[tuple[str, list]] = []
    held = 0
    for _, group in groupby(rows(), key=lambda r: r[0]):
        states: dict[tuple, dict[str, int]] = {}
        for _, m, lo, hi, word, n in group:
            states.setdefault((m, lo, hi, word[:lo], word[len(word) - (m - hi) :]), {})[word] = n
        for (m, lo, hi, *_), counts in states.items():
            if len(counts) < 2:
                continue
            near: dict[str, list[str]] = {}
            for a, b in near_in_state(list(counts), m, lo, hi):
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
            for word, others in near.items():
                out.append((word, [(counts[o], o) for o in others]))
                held += len(others)
        if held > 50_000:
            yield _near_rows(out)
            out, held = [], 0
    if out:
        yield _near_rows(out)


def _near_rows(out: list[tuple[str, list]]) -> pa.RecordBatch:
    flat = [x for _, others in out for x in others]
    parts = pa.StructArray.from_arrays([pa.array([n for n, _ in flat], pa.int64()), pa.array([w for _, w in flat], pa.string())], fields=list(NEAR.value_type))
    ends = np.cumsum([0, *(len(others) for _, others in out)], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), parts).cast(NEAR)
    return pa.record_batch({"word": pa.array([w for w, _ in out], pa.string()), "near": lists})


def near_words(words: DataFrame, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """(word, near array<struct<n, word>>) of every word of (word, n) with a near word: all words one edit away."""
    words = shared(words.where("word != ''").groupBy("word").agg(F.sum("n").alias("n")))
    states = initial_states(words, limit, window)
    found = states.repartition("key").sortWithinPartitions("key").mapInArrow(
        _compose, "word string, near array<struct<n: bigint, word: string>>"
    )
    # a word has at most some hundred near words: one for each place and letter
    return found.groupBy("word").agg(F.flatten(F.collect_list("near")).alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) end; they must lead upwards. Each round doubles the way made."""
    links = shared(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = shared(links.join(ahead, "root", "left").select("word", "root", "next"))
        if moved.where("next IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = 5, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n).

    The form is the near word of largest count (ties: smallest in code-point
    order), if that is at least ``ratio`` times the word's own.
    """
    words = shared(words)
    best = F.array_min(F.transform("near", lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word"))))
    near = shared(near_words(words, limit, window).select("word", F.size("near").cast("long").alias("n_near"), best.alias("best")))
    strong = -F.col("best.n") >= ratio * F.col("n")
    rated = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"),
    )
    rated = shared(rated)
    ends = roots(rated.where("form IS NOT NULL"))
    return rated.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


ORACLE = """
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS MATERIALIZED (
  SELECT run, k, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) AS h
  FROM runs, tab
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near
), rated AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form,
    CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), path AS (
  SELECT word, word AS root, form AS next FROM rated
  UNION ALL SELECT p.word, r.word, r.form FROM path p JOIN rated r ON p.next = r.word
)
SELECT r.word, r.form, p.root, r.n, CAST(r.n_near AS BIGINT) AS n_near, CAST(r.form_n AS BIGINT) AS form_n
FROM rated r JOIN path p ON p.word = r.word AND p.next IS NULL
"""
