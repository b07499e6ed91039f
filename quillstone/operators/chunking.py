"""Documents into chunks with exact offsets: one ordered pass over each document's own text, in Arrow batches without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import fixed, tokens

SENTENCE = re.compile(r"[.!?؟。…]+['\")\]]*\s+|\n+")
CLAUSE = re.compile(r"[,;:،]\s+")


def pieces(text: str, a: int, b: int, most: int) -> Iterator[tuple[int, int]]:
    """A stretch longer than ``most`` cut after a clause, else a space, else hard."""
    while b - a > most:
        cut = max((m.end() for m in CLAUSE.finditer(text, a, a + most)), default=0)
        if cut <= a + most // 2:
            space = text.rfind(" ", a, a + most)
            cut = space + 1 if space > a else a + most
        yield a, cut
        a = cut
    if b > a:
        yield a, b


def sentences(text: str, most: int) -> Iterator[tuple[int, int]]:
    a = 0
    for m in SENTENCE.finditer(text):
        yield from pieces(text, a, m.end(), most)
        a = m.end()
    yield from pieces(text, a, len(text), most)


def cut(text: str, target: int = fixed.CHUNK_TARGET, most: int = fixed.CHUNK_MAX, least: int = fixed.CHUNK_MIN, overlap: int = fixed.CHUNK_OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of each chunk: whole sentences up to the target, a short last one joined if it fits, overlap in whole sentences."""
    spans: list[list[int]] = []
    ends: list[list[int]] = []
    for a, b in sentences(text, most):
        if spans and b - spans[-1][0] <= target:
            spans[-1][1] = b
            ends[-1].append(a)
        else:
            spans.append([a, b])
            ends.append([a])
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] < least and spans[-1][1] - spans[-2][0] <= most:
        spans[-2][1] = spans[-1][1]
        ends[-2] += ends[-1]
        spans.pop()
        ends.pop()
    out = []
    for k, (a, b) in enumerate(spans):
        starts = [s for s in ends[k - 1][1:] if a - s <= overlap] if k else []
        out.append((a, b, a - min(starts) if starts else 0))
    return [(a, b, o) for a, b, o in out if text[a:b].strip()]


#: Documents whose chunks are held at a time.
TOGETHER = 200
CHUNK = "doc_id long, chunk_index long, char_start long, char_end long, overlap_chars long, token_count long, content string"


def chunked(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, chunk_index, char_start, char_end, overlap_chars, token_count, content). Null and blank texts have no chunks."""
    names = [f.split()[0] for f in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(first, TOGETHER)
                columns: list[list] = [[] for _ in names]
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    for k, (a, b, o) in enumerate(cut(text or "", **options)):
                        content = text[a - o : b]
                        for column, value in zip(columns, (doc_id, k, a, b, o, tokens.estimate(content), content), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "content" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)
