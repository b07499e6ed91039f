"""The language of Latin text by ranked trigrams: profiles learned from labelled texts, the distance of a text's own ranking from each, the margin as confidence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams of a profile; letters below which nothing is said; distance to the second best, as a share of the best's, below which nothing is said.
RANKS, LEAST, MARGIN = 300, 20, 0.02
#: Languages learned at most: a profile each is broadcast.
LANGUAGES = 500
_REST = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a text's words, each word between two blanks, as sorted whole numbers, and how often each stands."""
    c = np.frombuffer(f" {_REST.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.unique(t[c[1:-1] != 32], return_counts=True)  # none across words


def ranked(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The most frequent RANKS trigrams, in order; equals by their number."""
    return gram[np.lexsort((gram, -count))[:RANKS]]


@dataclass(frozen=True)
class Profiles:
    """names[k]'s trigrams sorted by number, grams[k], and the rank of each, ranks[k]."""

    names: list[str]
    grams: list[np.ndarray]
    ranks: list[np.ndarray]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """For each language the mean way between a trigram's rank in the text and in the profile; RANKS for one that the profile lacks."""
        out = []
        for gram, rank in zip(self.grams, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
            way = np.where(gram[at] == own, np.abs(rank[at] - np.arange(len(own))), RANKS)
            out.append(way.mean())
        return np.array(out)


def train(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages named in the rows where ``labelled`` holds, from all their text. Trigrams are counted in tasks and summed by shuffle; a language keeps RANKS of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[str, list] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                of.setdefault(lang, []).append(text)
            for lang, texts in of.items():
                gram, n = trigrams(" ".join(texts))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram), "n": pa.array(n.astype(np.int64))})

    rows = docs.filter(labelled).select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < RANKS).toArrow().to_pydict()
    names = sorted(set(top["lang"]))
    if len(names) > LANGUAGES:
        raise ValueError(f"{len(names)} languages; {LANGUAGES} at most")
    grams, ranks = [], []
    for name in names:
        own = sorted((g, r) for g, r, x in zip(top["gram"], top["rank"], top["lang"], strict=True) if x == name)
        grams.append(np.array([g for g, _ in own], np.int64))
        ranks.append(np.array([r for _, r in own], np.int64))
    return Profiles(names, grams, ranks)


def told(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """(language or und, confidence): the nearest profile, and how much farther the second is, as a share of its own distance."""
    if not text or not profiles.names or sum(len(w) for w in _REST.split(text)) < LEAST:
        return "und", 0.0
    far = profiles.distances(ranked(*trigrams(text)))
    order = np.argsort(far, kind="stable")
    margin = 1.0 if len(order) == 1 else float((far[order[1]] - far[order[0]]) / max(far[order[0]], 1e-9))
    return (profiles.names[order[0]] if margin >= MARGIN else "und"), round(min(margin, 1.0), 4)


def detect(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, confidence) of every row's whole text; und for texts of fewer than LEAST letters, null ones included, and for those between two languages."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = held.value
        for batch in batches:
            found = [told(t, profiles) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([x for x, _ in found], pa.string()), pa.array([c for _, c in found], pa.float64())], ["key", "lang", "confidence"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang string, confidence double").withColumnRenamed("key", key)
