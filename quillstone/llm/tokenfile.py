"""Token ids in files: a shared zstandard dictionary, a frame for each document, an offset index.

A segment is: the magic, the SHA-256 of the dictionary, the width of an id in bytes, the count of documents; then whether each has a doc_id,
the doc_ids, the counts of ids and the frames' ends; then the frames. One document is read by its index entry alone. Segments are
rows of a Parquet table, so that any store that Spark reaches can hold them and a lost task leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from ._shared import kept, modest_batches, settle
from .bpe import TOGETHER, Memo

MAGIC = b"QSTOKEN1"
HEAD = struct.Struct("<8s32sII")
#: Bytes of frames after which a segment ends; the dictionary's size; documents that it is trained on, and characters of the longest of them.
SEGMENT, DICTIONARY, SAMPLE, SAMPLE_CHARS = 1 << 20, 1 << 16, 1000, 1 << 15
LEVEL = 3
#: Latin letters, and ASCII marks after them (but for the apostrophe, with which endings begin), which the usual split sets apart.
MARKED = r"^(?P<core>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<marks>[!-&(-/:-@\[-`{-~]+)$"


class Words(Memo):
    """Encodes whole texts with the tokenizers library, each distinct stretch between word ends once.

    The library's defaults hold: the string of an added token in a text becomes that token. A file of another kind than byte-level BPE with the usual
    split, or with added tokens that look at their surroundings, is used on each text whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        said = json.loads(spec)
        split, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not said.get("normalizer") and not said.get("post_processor")
        super().__init__(cuts=bool(usual) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added) and not any(" " in t["content"] for t in added))
        self.tok, self.letters = Tokenizer.from_str(spec), Tokenizer.from_str(spec)
        self.letters.pre_tokenizer = CharDelimiterSplit(" ")
        size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # A byte-level token has a character for each of its bytes; an added one is text.
        self.width = np.array([len(self.tok.id_to_token(k) or "") for k in range(size)])
        for t in added:
            self.width[t["id"]] = len(t["content"].encode())

    def learn(self, new: pa.Array) -> pa.Array:
        """Words of letters and marks after them are put together from both, which no token joins. Words of ASCII letters need no split by pattern; the rest does."""
        parts = pc.extract_regex(new, MARKED)
        apart = parts.is_valid()
        core, marks = (parts.filter(apart).field(k).cast(pa.string()) for k in range(2))
        whole = pa.concat_arrays([new.filter(pc.invert(apart)), core]).unique()
        near = pc.index_in(whole, value_set=self.known)
        todo = whole.filter(near.is_null())
        plain = pc.ascii_is_alpha(todo)  # only ASCII letters, and some
        one, two = todo.filter(plain), todo.filter(pc.invert(plain))
        have = pa.concat_arrays([whole.filter(near.is_valid()), one, two])
        ids = pa.concat_arrays([self.ids.take(near.drop_null()), self._joined(one, self.letters, "\u0120"), self._joined(two, self.tok, " ")])  # \u0120: how a byte-level vocabulary writes a space
        end = marks.dictionary_encode()
        ends = pa.array(self.learn_heads(end.dictionary.to_pylist()), pa.large_binary()).take(end.indices)
        made = pc.binary_join_element_wise(ids.take(pc.index_in(core, value_set=have)), ends, pa.scalar(b"", pa.large_binary()))
        mask = np.asarray(apart)
        where = np.zeros(len(new), np.int64)
        where[mask] = len(ids) + np.arange(len(made))
        where[~mask] = np.asarray(pc.index_in(new.filter(pc.invert(apart)), value_set=have))
        return pa.concat_arrays([ids, made]).take(pa.array(where))

    def _joined(self, new: pa.Array, tok: Tokenizer, space: str) -> pa.Array:
        """Pieces are encoded as one text, and their ids told apart by the bytes that they stand for: no token crosses from one to the next."""
        between = space if space == " " else f" {space}"
        words, size, raw, cuts, before = new.to_pylist(), np.asarray(pc.binary_length(new), np.int64) + 1, [], [np.zeros(1, np.int64)], 0
        for a in range(0, len(words), 400):
            ids = np.array(tok.encode_batch_fast([space + between.join(words[a : a + 400])], add_special_tokens=False)[0].ids, np.int64)
            cuts.append(np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[a : a + 400])) + 1 + before)
            raw.append(ids.astype(self.kind).tobytes())
            before += len(ids)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.concatenate(cuts) * self.kind.itemsize), pa.py_buffer(b"".join(raw))])

    def learn_heads(self, new: list[str]) -> list[bytes]:
        return [np.array(self.tok.encode_batch_fast([x], add_special_tokens=False)[0].ids, self.kind).tobytes() for x in new]

    def ended(self, texts: pa.Array, end: int) -> Iterator[bytes]:
        """Each text's ids and the end id."""
        last = np.array([end], self.kind).tobytes()
        return (x + last for x in self.encode(texts))


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary from serialised id arrays; few or no samples give their own bytes, or nothing."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def pack(doc_ids: list[int | None], counts: list[int], frames: list[bytes], width: int, digest: bytes) -> bytes:
    n = len(frames)
    return b"".join([
        HEAD.pack(MAGIC, digest, width, n), np.array([x is not None for x in doc_ids], "u1").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array(counts, "<u8").tobytes(), np.cumsum([len(f) for f in frames], dtype="<u8").tobytes(), *frames,
    ])


class Segment:
    """A segment's index; read(k) decompresses document k and nothing else."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, digest, self.width, self.n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        n, at = self.n, HEAD.size
        there = np.frombuffer(data, "u1", n, at)
        ids = np.frombuffer(data, "<i8", n, at + n)
        self.doc_ids = [int(x) if t else None for x, t in zip(ids, there, strict=True)]
        self.counts = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        self.ends = np.frombuffer(data, "<u8", n, at + 17 * n).astype(np.int64)
        self.body, self.data = at + 25 * n, memoryview(data)
        d = _dictionary(dictionary)
        self.unzip = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()

    def read(self, k: int) -> np.ndarray:
        a = self.body + (int(self.ends[k - 1]) if k else 0)
        raw = self.unzip.decompress(self.data[a : self.body + int(self.ends[k])])
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, spec: str, end: int = 0) -> tuple[DataFrame, bytes]:
    """Encodes every whole text (null: empty), appends the end id, and writes segments in ascending doc_id order (nulls first; rows that share one by a hash of their text).

    Returns the written table (part, seq, base: ids before the segment in its part, n_ids, first_id and last_id: the least and greatest doc_id in it, segment) and the
    dictionary. The dictionary is trained on about SAMPLE whole documents, twice as many at most, picked by a hash of their doc_id among those of SAMPLE_CHARS
    characters at most; it only sets how small frames get. A very long text is encoded whole, in one task, and is a frame of its own; an empty table gives no
    segments; other columns, whatever their names, are not read.
    """
    spark: SparkSession = docs.sparkSession
    modest_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    step = max(1, rows.select("doc_id").count() // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).filter(F.length("text") <= SAMPLE_CHARS).select("text").limit(2 * SAMPLE).toArrow()["text"].combine_chunks()
    dictionary = train(list(Words(spec).ended(sample, end)))
    held = spark.sparkContext.broadcast((spec, dictionary))  # the tokenizer's file and 64 KiB at most

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, dictionary = held.value
        own, digest, d = kept(Words, spec), hashlib.sha256(dictionary).digest(), _dictionary(dictionary)
        zipper = zstandard.ZstdCompressor(level=LEVEL, dict_data=d) if d else zstandard.ZstdCompressor(level=LEVEL)
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, frames, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            known = [x for x in doc_ids if x is not None]
            first, last = (pa.array([f(known) if known else None], pa.int64()) for f in (min, max))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "base": [base], "n_ids": [sum(counts)], "first_id": first, "last_id": last, "segment": pa.array([pack(doc_ids, counts, frames, own.kind.itemsize, digest)], pa.binary())})

        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(a, TOGETHER)
                for doc_id, ids in zip(some["doc_id"].to_pylist(), own.ended(some["text"], end), strict=True):
                    doc_ids.append(doc_id)
                    counts.append(len(ids) // own.kind.itemsize)
                    frames.append(zipper.compress(ids))
                    size += len(frames[-1])
                    if size >= SEGMENT:
                        yield out()
                        seq, base = seq + 1, base + sum(counts)
                        doc_ids, counts, frames, size = [], [], [], 0
        if frames:
            yield out()

    keys = ["doc_id", "_hash", "_tie"]
    ranged = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    made = ranged.select("doc_id", "text").mapInArrow(segments, "part int, seq int, base long, n_ids long, first_id long, last_id long, segment binary")
    return settle(made, "tokens", "none"), dictionary


def read(segments: DataFrame, dictionary: bytes) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and the CRC-32 of its ids as 32-bit integers."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # One row for each range of the sort, whatever the input.
    placed = segments.join(F.broadcast(parts), "part").select((F.col("before") + F.col("base")).alias("start"), "segment")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch["start"].to_pylist(), batch["segment"], strict=True):
                s = Segment(data.as_py(), dictionary)
                ids = [s.read(k) for k in range(s.n)]
                n = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Documents fetched at a time.
FETCHED = 10_000


def fetch(segments: DataFrame, dictionary: bytes, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents named, FETCHED at most. Only segments whose range of ids holds one of them are read, and of these only the frames asked for are inflated.

    Rows that share a doc_id come each; ids that stand in no segment give no row.
    """
    asked = sorted(set(doc_ids))
    if len(asked) > FETCHED:
        raise ValueError(f"{len(asked)} documents; fetch {FETCHED} at most")
    if not asked:
        return segments.limit(0).selectExpr("first_id AS doc_id", "cast(array() AS array<bigint>) AS ids")
    # A few stretches between the asked ids reach the scan as a filter on the columns' statistics.
    cuts = [asked[k : k + -(-len(asked) // 64)] for k in range(0, len(asked), -(-len(asked) // 64))]
    near = reduce(lambda a, b: a | b, [(F.col("first_id") <= c[-1]) & (F.col("last_id") >= c[0]) for c in cuts])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(asked)
        for batch in batches:
            for data in batch["segment"]:
                s = Segment(data.as_py(), dictionary)
                found = [k for k, x in enumerate(s.doc_ids) if x in wanted]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[k] for k in found], pa.int64()), pa.array([s.read(k).astype(np.int64) for k in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return segments.filter(near).select("segment").mapInArrow(rows, "doc_id long, ids array<long>")
