"""Byte-level BPE by corpus-level merge replay.

The distinct words of many documents are laid end to end as one array of tokens with links to left and right neighbours. An inverted
index holds, for each merge, the positions whose pair it joins. Merges are replayed in rank order over the whole array; each touches
only the neighbours of the positions it joins, whose new pairs enter the index. Every word thus ends as if encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from ._shared import kept, modest_batches

#: White space as the Unicode property has it, which ``\s`` of the pattern means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space after something that is no white space: a word always ends before it.
BREAK = re.compile(r"(?<=\S) ")
#: White space (as Python has it, which is more than the property) and a space, in the other engine's notation: texts without it are cut at every space.
APART = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Fixed value: the pattern that the cuts at spaces are right for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a task, the longest one remembered, the longest of single words, documents taken from a batch together, bytes of texts whose
#: pieces are numbered together, pieces held of a huge text, and bytes from which a text is huge.
KEPT, LONG, SHORT, TOGETHER, ROUND, STEP, HUGE = 500_000, 60, 12, 512, 2_000_000, 100_000, 1_000_000
#: Pieces that a worker remembers unless it is told otherwise: modest, since other stages share its executor.
REMEMBERED = 300_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def explicit(pattern: str) -> str:
    """The pattern with the property's white space spelled out, since engines differ in what ``\\s`` is."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def pieces(text: str) -> Iterator[list[str]]:
    """Lists of stretches of the text that no match of PATTERN crosses. The text is all of them joined by spaces; each space belongs to what follows it."""
    at = 0
    cuts = (m.start() for m in BREAK.finditer(text))
    while True:
        some = list(islice(cuts, STEP))
        ends = some or [len(text)]
        yield [text[a:b] for a, b in zip([at, *(x + 1 for x in ends[:-1])], ends, strict=True)]
        at = ends[-1] + 1
        if not some:
            return


class Replay:
    """Encodes distinct words together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        #: The token that a pair of tokens joins to, by left << 32 | right: every way to cut a token into two.
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        get = self.pairs.get
        self.first = np.array([get(a << 32 | b, -1) for a in self.single.tolist() for b in self.single.tolist()])

    def encode(self, words: list[bytes]) -> list[list[int]]:
        whole = [self.ranks.get(w) for w in words]
        apart = [w for w, r in zip(words, whole, strict=True) if r is None and w]
        size = np.array([len(w) for w in apart], np.int64)
        raw, end = np.frombuffer(b"".join(apart), np.uint8).astype(np.int64), np.cumsum(size)
        n = len(raw)
        links = np.arange(1, n + 1)
        links[end - 1] = -1
        joins = np.full(n, -1)
        joins[:-1] = self.first[raw[:-1] * 256 + raw[1:]]
        joins[end - 1] = -1
        order = np.argsort(joins, kind="stable")
        merges, at = np.unique(joins[order], return_index=True)
        spots, ends = order.tolist(), [*at[1:].tolist(), n]
        index = {r: spots[i:j] for r, i, j in zip(merges.tolist(), at.tolist(), ends, strict=True) if r >= 0} if n else {}
        back = np.arange(-1, n - 1)
        back[end - size] = -1
        token = self.single[raw].tolist()
        self._replay(index, joins.tolist(), token, links.tolist(), back.tolist())
        out, rest = [], iter(zip((end - size).tolist(), end.tolist(), strict=True))
        for w, r in zip(words, whole, strict=True):
            if r is not None:
                out.append([r])
            elif not w:
                out.append([])
            else:
                a, b = next(rest)
                out.append([t for t in token[a:b] if t >= 0])
        return out

    def _replay(self, index: dict[int, list[int]], joins: list[int], token: list[int], right: list[int], left: list[int]) -> None:
        """Joins pairs in rank order. joins: the token that a position and its right neighbour make now, or -1; what has been joined to its left has token -1."""
        get, find = self.pairs.get, index.get
        heap = sorted(index)
        while heap:
            r = heappop(heap)
            spots = index.pop(r, None)
            if spots is None:
                continue
            spots.sort()
            wide = r << 32
            for k, p in enumerate(spots):
                if joins[p] != r:
                    continue
                q = right[p]
                token[p] = r
                token[q] = joins[q] = -1
                right[p] = n = right[q]
                better = False
                x = -1
                if n >= 0:
                    left[n] = p
                    x = get(wide | token[n], -1)
                    if x >= 0:
                        known = find(x)
                        if known is None:
                            index[x] = [p]
                            heappush(heap, x)
                        else:
                            known.append(p)
                        better = x < r
                joins[p] = x
                m = left[p]
                if m >= 0:
                    joins[m] = x = get(token[m] << 32 | r, -1)
                    if x >= 0:
                        known = find(x)
                        if known is None:
                            index[x] = [m]
                            heappush(heap, x)
                        else:
                            known.append(m)
                        better = better or x < r
                if better:  # a merge of lower rank has appeared: it goes first
                    if rest := spots[k + 1 :]:
                        if (known := find(r)) is None:
                            index[r] = rest
                            heappush(heap, r)
                        else:
                            known += rest
                    break


NO_WORDS, NO_IDS = pa.array([], pa.string()), pa.array([], pa.large_binary())


class Memo:
    """Whole texts to bytes of ids, each distinct piece once; what it remembers stays within bounds. Words and ids are Arrow columns, not Python objects."""

    def __init__(self, kept: int = KEPT, cuts: bool = True) -> None:
        self.kept, self.cuts = kept, cuts
        self.known, self.ids = NO_WORDS, NO_IDS  # pieces, without the space before them that their ids hold
        self.old, self.old_ids = NO_WORDS, NO_IDS  # the generation before; what is met again moves on
        self.heads: dict[str, bytes] = {}

    def learn(self, new: pa.Array) -> pa.Array:
        """The ids of each piece with a space before it, in their order."""
        raise NotImplementedError

    def learn_heads(self, new: list[str]) -> list[bytes]:
        """The ids of texts' first pieces, which have no space before them."""
        raise NotImplementedError

    def _heads(self, first: list[str]) -> list[bytes]:
        heads = self.heads
        if len(heads) > self.kept // 20:
            heads.clear()
        new = [x for x in set(first) if x not in heads]
        fresh = dict(zip(new, self.learn_heads(new), strict=True)) if new else {}
        heads.update((x, y) for x, y in fresh.items() if len(x) <= LONG)
        return [heads[x] if x in heads else fresh[x] for x in first]

    def of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct pieces: known, from the old generation, or learned."""
        where = np.array(pc.index_in(words, value_set=self.known).fill_null(-1), np.int64)
        lost, n = where < 0, len(self.known)
        ids = self.ids
        if lost.any():
            new = words.filter(pa.array(lost))
            at = np.array(pc.index_in(new, value_set=self.old).fill_null(-1), np.int64)
            unknown = at < 0
            at[unknown] = len(self.old) + np.arange(unknown.sum())
            learned = self.learn(new.filter(pa.array(unknown))) if unknown.any() else NO_IDS
            got = pa.concat_arrays([self.old_ids, learned]).take(pa.array(at))
            where[lost] = n + np.arange(len(new))
            ids = pa.concat_arrays([ids, got])
            if 2 * n > self.kept:
                self.old, self.old_ids, self.known, self.ids = self.known, self.ids, NO_WORDS, NO_IDS
            short = pc.less_equal(pc.binary_length(new), LONG)
            self.known, self.ids = pa.concat_arrays([self.known, new.filter(short)]), pa.concat_arrays([self.ids, got.filter(short)])
        return ids.take(pa.array(where))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: none). Texts of ordinary length are cut and their pieces numbered in Arrow, many texts at a time."""
        texts = texts.cast(pa.string()).fill_null("")
        size = np.asarray(pc.binary_length(texts), np.int64)
        ends = np.flatnonzero(np.diff((np.cumsum(size) - size) // ROUND)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(texts)], strict=True):
            some, huge = texts.slice(a, b - a), (size[a:b] >= HUGE) | (not self.cuts)
            odd = np.asarray(pc.match_substring_regex(some, APART)) & ~huge
            cut = pc.split_pattern(some.filter(pa.array(~odd & ~huge)), " ")
            spaced = [list(chain.from_iterable(pieces(t))) for t in some.filter(pa.array(odd)).to_pylist()]
            usual, others = self._round(cut.flatten(), np.asarray(cut.offsets, np.int64)), self._round(pa.array(chain.from_iterable(spaced), pa.string()), np.cumsum([0, *map(len, spaced)]))
            for k, (alone, apart) in enumerate(zip(huge.tolist(), odd.tolist(), strict=True)):
                yield self._huge(some[k].as_py()) if alone else next(others if apart else usual)
        pa.default_memory_pool().release_unused()

    def _round(self, flat: pa.Array, starts: np.ndarray, first: bool = True) -> Iterator[bytes]:
        """Of texts' pieces laid end to end, and where the texts start and end among them; first: they begin with their heads."""
        if len(starts) < 2:
            return iter(())
        flat, starts = flat.dictionary_encode(), starts - starts[0]
        which, words = np.array(flat.indices, np.int64), flat.dictionary
        heads = starts[:-1] if first else starts[:0]
        of_head = words.take(pa.array(which[heads])).to_pylist()
        which[heads] = len(words) + np.arange(len(heads))
        used = np.bincount(which, minlength=len(words))[: len(words)] > 0  # some words stand only first
        if not used.all():
            which = np.append(np.cumsum(used) - 1, used.sum() + np.arange(len(heads)))[which]
            words = words.filter(pa.array(used))
        # Taking entries of one binary column lays the ids end to end; the texts' ends are among its offsets.
        laid = pa.concat_arrays([self.of(words), pa.array(self._heads(of_head), pa.large_binary())]).take(pa.array(which))
        at = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1][starts].tolist()
        data = memoryview(laid.buffers()[2] or b"")
        return (bytes(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True))

    def _huge(self, text: str) -> bytes:
        """A text piece by piece, in steps; or whole, where no place is known that a match never crosses."""
        steps = pieces(text) if self.cuts else [[text]]
        return b"".join(b"".join(self._round(pa.array(some, pa.string()), np.array([0, len(some)]), k == 0)) for k, some in enumerate(steps))


class Codec(Memo):
    """Whole texts to ids (little-endian, 32 bits) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        super().__init__(kept, pattern == PATTERN)
        self.short: dict[str, bytes] = {}  # of single words
        self.words = pattern == PATTERN
        self.replay, self.pattern = Replay(ranks), regex.compile(explicit(pattern))

    def learn(self, new: pa.Array) -> pa.Array:
        words = new.to_pylist()
        return pa.array(self._encode([f" {x}" for x in words], [x.isalpha() for x in words]), pa.large_binary())

    def learn_heads(self, new: list[str]) -> list[bytes]:
        return self._encode(new)

    def _encode(self, stretches: list[str], letters: list[bool] | None = None) -> list[bytes]:
        """letters: which stretches are known to be one match of the pattern, a space and letters."""
        match = self.pattern.findall
        split = [[x] if y else match(x) for x, y in zip(stretches, letters, strict=True)] if letters and self.words else [match(x) for x in stretches]
        distinct, short = set(chain.from_iterable(split)), self.short
        if len(short) > self.kept // 6:
            short.clear()
        words = [w for w in distinct if w not in short]
        flat = self.replay.encode([w.encode() for w in words])
        ids = dict(zip(words, (array("I", x).tobytes() for x in flat), strict=True))
        for w in distinct:
            if w in short:
                ids[w] = short[w]
            elif len(w) <= SHORT:
                short[w] = ids[w]
        return [ids[s[0]] if len(s) == 1 else b"".join(map(ids.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec(ranks: bytes, pattern: str, remembered: int) -> Codec:
    return Codec(read_ranks(ranks), pattern, remembered)


def digests(docs: DataFrame, ranks: bytes, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """Per document: doc_id, the count of ids, the SHA-256 of the ids (little-endian, 32 bits) and that of the bytes they decode to.

    ``ranks`` is a vocabulary file's content; ``remembered`` bounds the pieces that a worker remembers (some 300 bytes each), which only sets its speed. Each match of the pattern is encoded by itself, without special tokens; texts are cut at spaces only for PATTERN, and matched whole for any other. A worker replays the merges over each round's new words, so a word is replayed once for as long as a worker remembers it. A null text is
    empty; an empty text has no ids and the digests of nothing. Rows keep their order and repeats; an empty table gives none; a very long text is encoded whole, piece by piece; other columns are not read.
    """
    return _mapped(docs, ranks, pattern, remembered, False)


def encoded(docs: DataFrame, ranks: bytes, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """Per document: doc_id and its ids as an array; handles rows as digests() does."""
    return _mapped(docs, ranks, pattern, remembered, True)


def _mapped(docs: DataFrame, ranks: bytes, pattern: str, remembered: int, whole: bool) -> DataFrame:
    modest_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file, about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(codec, held.value, pattern, remembered)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                ids = list(own.encode(part["text"]))
                if whole:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])
                else:
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(own.decode(x)) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, ids array<int>" if whole else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
