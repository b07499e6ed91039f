"""Maximal runs of repeated words by Crochemore's partition refinement.

Positions of equal factors of length l form a class. The classes of length l + 1 come from those of length l by the smaller-half rule: of the parts into
which a class was cut, all but the largest are looked at, and the positions before theirs leave their own classes. Neighbouring members of a class that
stand l apart begin a square of period l; squares of one period at positions in a row merge into a run. A position that changes its next neighbour
says so once, so the squares of all lengths are read from these sayings at the end. The texts of a batch are refined together.

Only runs of at least four periods are asked for, so two things end early: a class of fewer than three members can hold no square of such a run, and no
period above a quarter of the text can have one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import modest_batches, spans

#: Words refined together; a longer text is refined alone. Words that a task remembers. Fewest words and periods of a run.
TOGETHER, KNOWN, WORDS, PERIODS = 400_000, 500_000, 6, 4
LEAST = PERIODS - 1
Edit = Callable[[int | None, list[bytes]], list[bytes]]


class _Classes:
    """The classes of equal factors of all texts of a batch, with each position's neighbours inside its class."""

    def __init__(self, word: np.ndarray, lengths: np.ndarray):
        n = len(word)
        text = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        self.first = np.repeat(ends - lengths, lengths)
        self.limit = np.repeat(lengths // PERIODS, lengths)
        self.of, self.at = np.full(n, -1), np.zeros(n, np.int64)
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        self.said: list[tuple[np.ndarray, int, np.ndarray]] = []
        key = text * (int(word.max(initial=0)) + 1) + word
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, n))
        alive = size >= LEAST
        self.members = order[np.repeat(alive, size)]  # a class after another
        size = size[alive]
        self.classes = len(size)
        self.size, self.start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.size[: len(size)], self.start[: len(size)] = size, np.cumsum(size) - size
        self.of[self.members] = np.repeat(np.arange(len(size)), size)
        self.at[self.members] = np.arange(len(self.members))
        self._chain(self.members, np.append(True, self.of[self.members][1:] != self.of[self.members][:-1])[: len(self.members)], 1)
        self.small = np.arange(n)  # at first every class counts as small
        self.ended = ends[lengths > 0] - 1  # a text's last position has no factor of two words

    def _say(self, where: np.ndarray, level: int, apart: np.ndarray) -> None:
        if len(where):
            self.said.append((where, level, apart))

    def _chain(self, p: np.ndarray, begins: np.ndarray, level: int) -> None:
        """p: positions, ascending inside each class; begins: where a class begins. They become each other's neighbours."""
        if not len(p):
            return
        then = np.append(p[1:], -1)
        then[np.append(begins[1:], True)] = -1
        last = np.append(-1, p[:-1])
        last[begins] = -1
        new = self.next[p] != then
        self.next[p], self.before[p] = then, last
        self._say(p[new], level, np.where(then[new] < 0, 0, then[new] - p[new]))

    def _kill(self, p: np.ndarray, level: int) -> None:
        self.of[p] = self.next[p] = self.before[p] = -1
        self._say(p, level, np.zeros(len(p), np.int64))

    def refine(self) -> None:
        level = 1
        while len(self.small) or len(self.ended):
            level += 1
            self._step(level)

    def _step(self, level: int) -> None:
        p = np.sort(self.small)
        own = p[p > self.first[p]] - 1
        # The last position that has a factor of the former length has none of this one.
        ended = self.ended
        ended = ended[self.limit[ended] >= level]
        self.ended = ended[ended > self.first[ended]] - 1
        own = own[(self.of[own] >= 0) & (self.limit[own] >= level)]
        ended = ended[self.of[ended] >= 0]
        follow = self.of[own + 1]
        if len(ended):
            stays = ~np.isin(own, ended, assume_unique=True)
            own, follow = np.append(own[stays], ended), np.append(follow[stays], np.full(len(ended), -1))
            by = np.argsort(own)
            own, follow = own[by], follow[by]
        if not len(own):
            self.small = own
            return
        parent = self.of[own]
        order = np.argsort(parent * (self.classes + 1) + follow + 1, kind="stable")
        r, x, s = own[order], parent[order], follow[order]
        begins = np.append(True, (x[1:] != x[:-1]) | (s[1:] != s[:-1]))
        group = np.cumsum(begins) - 1
        size = np.bincount(group)
        whole = (size == self.size[x[begins]]) & (s[begins] >= 0)  # the class as it was
        if whole.any():
            stays = ~whole[group]
            r, x, s, begins = r[stays], x[stays], s[stays], begins[stays]
            if not len(r):
                self.small = r
                return
            group = np.cumsum(begins) - 1
            size = np.bincount(group)
        self._split(r, x, s[begins] >= 0, begins, group, size, level)

    def _split(self, r: np.ndarray, x: np.ndarray, lives: np.ndarray, begins: np.ndarray, group: np.ndarray, size: np.ndarray, level: int) -> None:
        """The positions r leave their classes x in groups; what is left of x stays one class."""
        opens = np.append(True, x[1:] != x[:-1])
        cls = x[opens]
        gone = np.diff(np.append(np.flatnonzero(opens), len(x)))
        end = self.start[cls] + self.size[cls]
        left = self.size[cls] - gone
        # Neighbours of what leaves meet each other.
        by = np.argsort(x * len(self.of) + r)
        rx, rp = x[by], r[by]
        joined = np.append(False, (rx[1:] == rx[:-1]) & (self.next[rp[:-1]] == rp[1:]))
        a, b = self.before[rp[~joined]], self.next[rp[np.append(~joined[1:], True)]]
        some = a >= 0
        self.next[a[some]] = b[some]
        self._say(a[some], level, np.where(b[some] < 0, 0, b[some] - a[some]))
        self.before[b[b >= 0]] = a[b >= 0]
        # They take the last places of their class; whoever stands there and stays takes theirs.
        slot = np.repeat(end - gone, gone) + np.arange(len(r)) - np.repeat(np.cumsum(gone) - gone, gone)
        held = self.members[slot]
        self.of[r] = -2
        stay = self.of[held] != -2
        self.of[r] = x
        hole = self.at[r] < np.repeat(end - gone, gone)
        self.members[self.at[r[hole]]] = held[stay]
        self.at[held[stay]] = self.at[r[hole]]
        self.members[slot], self.at[r] = r, slot
        # Groups become classes, or die.
        first = np.flatnonzero(begins)
        of_group = np.searchsorted(cls, x[first])
        lives = lives & (size >= LEAST)
        new = self.classes + np.cumsum(lives) - 1
        self.start[new[lives]], self.size[new[lives]] = slot[first[lives]], size[lives]
        self.classes += int(lives.sum())
        on = lives[group]
        self.of[r[on]] = new[group[on]]
        self._chain(r[on], begins[on], level)
        dead = [r[~on]]
        self.size[cls] = left
        few = (left < LEAST) & (left > 0)
        if few.any():
            dead.append(self.members[spans(self.start[cls[few]], left[few])])
            self.size[cls[few]] = 0
        dead = np.concatenate(dead)
        self._kill(dead, level)
        # All parts of a class but the largest are small.
        part = np.concatenate([of_group[lives], np.flatnonzero(left >= LEAST)])
        start = np.concatenate([self.start[new[lives]], self.start[cls[left >= LEAST]]])
        width = np.concatenate([size[lives], left[left >= LEAST]])
        by = np.lexsort((width, part))
        part, start, width = part[by], start[by], width[by]
        small = np.append(part[1:] == part[:-1], False) if len(part) else np.zeros(0, bool)
        self.small = np.concatenate([dead, self.members[spans(start[small], width[small])]])

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(period, position) of all squares found, by period and position."""
        if not self.said:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.concatenate([w for w, _, _ in self.said])
        level = np.repeat([v for _, v, _ in self.said], [len(w) for w, _, _ in self.said])
        apart = np.concatenate([d for _, _, d in self.said])
        by = np.argsort(where, kind="stable")
        where, level, apart = where[by], level[by], apart[by]
        until = np.append(np.where(where[1:] == where[:-1], level[1:], np.iinfo(np.int64).max), np.iinfo(np.int64).max)
        real = (apart >= level) & (apart < until) & (apart <= self.limit[where])
        where, apart = where[real], apart[real]
        by = np.lexsort((where, apart))
        return apart[by], where[by]


def runs(word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period. word: numbers of the words of all texts, one text after another."""
    classes = _Classes(word.astype(np.int64), lengths.astype(np.int64))
    classes.refine()
    period, at = classes.squares()
    if not len(at):
        return np.zeros((0, 4), np.int64)
    first = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)))
    last = np.append(first[1:], len(at)) - 1
    start, period = at[first], period[first]
    length = at[last] - start + 2 * period
    real = length >= np.maximum(WORDS, PERIODS * period)
    start, period, length = start[real], period[real], length[real]
    begin = np.cumsum(lengths) - lengths
    text = np.searchsorted(np.cumsum(lengths), start, "right")
    found = np.stack([text, start - begin[text], length, period], axis=1)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 1] + found[:, 3], 1)
    np.add.at(change, found[:, 1] + found[:, 2], -1)
    return np.cumsum(change[:n]) == 0


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period, by start and period) and collapsed, its words but those that only repeat a run.

    Words are stretches without space and tab to carriage return. A run is a stretch of words with smallest period q, of at least 6 and 4 * q words, that
    no neighbouring word extends; collapsed leaves out a run's words after its first q and joins the rest by single spaces. ``edit`` may turn a document's
    words into others first (it gets doc_id and the words). Exact for texts of any length; a text is one task's, and texts are refined about 400,000 words
    at a time. A null, empty or blank text has no words and no runs and an empty ``collapsed``. Rows that share a doc_id or have none are answered each for
    itself; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    modest_batches(docs.sparkSession)

    def answer(some: list[tuple[int | None, list[bytes]]], known: dict[bytes, int]) -> pa.RecordBatch:
        if len(known) > KNOWN:
            known.clear()
        lengths = np.array([len(w) for _, w in some], np.int64)
        numbers = np.fromiter((known.setdefault(w, len(known)) for _, words in some for w in words), np.int64, int(lengths.sum()))
        found = runs(numbers, lengths)
        cut = np.searchsorted(found[:, 0], np.arange(len(some) + 1))
        collapsed = []
        for k, (_, words) in enumerate(some):
            if cut[k] < cut[k + 1]:
                words = [words[i] for i in np.flatnonzero(_kept(len(words), found[cut[k] : cut[k + 1]]))]
            collapsed.append(b" ".join(words))
        each = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in some], pa.int64()), pa.array(lengths), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), each).cast(_TYPE), pa.array(collapsed, pa.binary()).view(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        some, total = [], 0
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for doc, text in zip(batch["doc_id"].to_pylist(), texts, strict=True):
                words = (text.as_py() or b"").split()  # on bytes: ASCII white space alone
                words = edit(doc, words) if edit else words
                if some and total + len(words) > TOGETHER:
                    yield answer(some, known)
                    some, total = [], 0
                some.append((doc, words))
                total += len(words)
        if some:
            yield answer(some, known)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, RUNS)


def oracle() -> str:
    """The query's rows in DuckDB: equal words are joined inside their text, and stretches of pairs equally far apart are runs unless a smaller period covers them."""
    return r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([1,2,3,4,5,6,7,8], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i::BIGINT) AS c
    FROM range(256) r(i))),
raw AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]), 4294967295::BIGINT))::BIGINT AS h
  FROM documents, tab),
cut AS (SELECT *, len(w) AS n, (h // 10) AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
edited AS MATERIALIZED (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN w[1:a] || list_transform(range(a, n), lambda i: w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))]) ELSE w END AS w FROM cut),
word AS MATERIALIZED (SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM edited),
pair AS (SELECT x.rid, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pair),
long AS MATERIALIZED (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM stretch GROUP BY rid, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT * FROM long r WHERE NOT EXISTS (
  SELECT 1 FROM long s WHERE s.rid = r.rid AND s.q < r.q AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
told AS (
  SELECT rid, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'q': q}, (length, -start, -q)) AS best,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM run GROUP BY rid),
lost AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM run),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN lost USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM edited LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""
