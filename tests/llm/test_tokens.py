"""Byte-level BPE and token files, against the tiktoken and tokenizers libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillstone.llm import bpe, tokenfile

ODD = [
    "", " ", "  ", "\n", " \n b", "a  b", "a \n\n  b", "it's  we'll 'dx", "tab\tx  y", "a\x1cb \x1c c", "\x85 x  y", "é" * 50, "a" * 3000, "ab" * 500 + " " * 40, "x\n" * 30,
    "漢字かな交じり文。" * 20, "🙂👩‍👩‍👧 ok", "<|endoftext|> and more", "12345 67,8 ½ ²", "​ ﻿ x", " lead", "trail ", "a b   c", "́ combining", "ſ'S 'ſ",
]


def texts() -> list[str]:
    rng = random.Random(7)
    pool = ["<|endoftext|>", "the", "of", "Ing", "'s", "ll", " ", "  ", "\n", "\t", "é", "ß", "漢", "9", "!", "***", " ", " ", "ment", "queeau", "'", "aaaa"]
    return ODD + ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(1500)]


def test_replay_matches_tiktoken():
    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = bpe.read_ranks(data)
    codec, theirs = bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t, ids in zip(texts(), codec.encode(pa.array(texts())), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_better_merge_that_appears_late_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"aba": 260, b"abab": 302}
    theirs = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for w in ("abab", "ababab", "abcab", "babaabab", "aabab"):
        assert bpe.Replay(ranks).encode([w.encode()]) == [theirs.encode_ordinary(w)]


def test_huge_text_goes_piece_by_piece(monkeypatch):
    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    text = "Tion was  thanon. " * 200
    whole = list(bpe.Codec(ranks, P.PATTERN).encode(pa.array([text])))
    monkeypatch.setattr(bpe, "HUGE", 10)
    monkeypatch.setattr(bpe, "STEP", 7)
    assert list(bpe.Codec(ranks, P.PATTERN).encode(pa.array([text]))) == whole


def test_words_match_tokenizers():
    spec = open(P.path("byte_bpe_50k.json")).read()
    theirs = Tokenizer.from_str(spec)  # as the library is by default: the string of an added token is that token
    for t, ids, e in zip(texts(), tokenfile.Words(spec).ended(pa.array(texts()), 0), theirs.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*e.ids, 0], repr(t)


def test_digests(spark):
    rows = [(1, "a b", 5), (2, None, 6), (2, None, 6), (None, "", 7), (3, "x" * 5000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((tuple(r) for r in bpe.digests(docs, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN).collect()), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    assert [r[0] for r in got].count(2) == 2 and (2, 0, nothing, nothing) in got and (None, 0, nothing, nothing) in got
    assert {r[0]: r[3] for r in got}[3] == hashlib.sha256(b"x" * 5000).hexdigest()
    assert bpe.digests(docs.limit(0), open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN).count() == 0


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 200)
    spec = open(P.path("byte_bpe_50k.json")).read()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts()[:300])] + [(7, "again", "y"), (7, "again", "y"), (900, None, "z")], "doc_id long, text string, part string").repartition(5)
    segments, dictionary = tokenfile.write(docs, spec)
    got = sorted(tuple(r) for r in tokenfile.read(segments, dictionary).collect())
    tok = Tokenizer.from_str(spec)
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((a, c, d) for a, _, c, d in got) == sorted((a, c, d) for a, _, c, d in want)
    assert [r for r in got if r[0] != 7] == [r for r in want if r[0] != 7]  # rows that share a doc_id follow their texts' hashes
    at = 0
    for _, begin, n, _ in sorted(got, key=lambda r: r[1]):
        assert begin == at
        at += n
    assert at == start
    with pytest.raises(ValueError):
        tokenfile.Segment(segments.first()["segment"], b"another")
    one = tokenfile.Segment(segments.first()["segment"], dictionary)
    assert len(one.read(one.n - 1)) == one.counts[-1]


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    segments, dictionary = tokenfile.write(docs, open(P.path("byte_bpe_50k.json")).read())
    assert tokenfile.read(segments, dictionary).count() == 0


def test_another_pattern_is_matched_whole():
    ranks = bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    pattern = r"\w+ \w+|\s+|[^\s]+"
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for t in ("the end of it all", "a b  c", ""):
        assert np.frombuffer(next(bpe.Codec(ranks, pattern).encode(pa.array([t]))), "<u4").tolist() == theirs.encode_ordinary(t)


def test_another_tokenizer_file_is_used_whole():
    spec = open(P.path("word_bpe_49k.json")).read()
    theirs = Tokenizer.from_str(spec)
    for t in ("The End of it, all", "a  b", ""):
        assert np.frombuffer(next(tokenfile.Words(spec).ended(pa.array([t]), 0)), "<u2").tolist() == [*theirs.encode(t, add_special_tokens=False).ids, 0]


def test_fetch_inflates_what_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 2000)
    spec = open(P.path("byte_bpe_50k.json")).read()
    theirs = Tokenizer.from_str(spec)
    rows = [(k, f"document {k} " + f"word{k % 7} " * (k % 90)) for k in range(0, 900, 3)] + [(3, "another three"), (None, "no id")]
    segments, dictionary = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), spec)
    ids = lambda t: [*theirs.encode(t, add_special_tokens=False).ids, 0]
    got = sorted((r.doc_id, r.ids) for r in tokenfile.fetch(segments, dictionary, [3, 600, 601, 10**9]).collect())
    assert got == sorted((k, ids(t)) for k, t in rows if k in (3, 600))
    assert tokenfile.fetch(segments, dictionary, []).collect() == [] and segments.count() > 1
    assert segments.filter("first_id > last_id").count() == 0

    def spoilt(data, keep):  # every frame but those of one document is overwritten
        s, out = tokenfile.Segment(data, dictionary), bytearray(data)
        for k in range(s.n):
            if s.doc_ids[k] != keep:
                a = s.body + (int(s.ends[k - 1]) if k else 0)
                out[a : s.body + int(s.ends[k])] = b"\xff" * (s.body + int(s.ends[k]) - a)
        return bytes(out)

    bad = spark.createDataFrame([(*r[:-1], spoilt(bytes(r.segment), 600)) for r in segments.collect()], segments.schema)
    assert [(r.doc_id, r.ids) for r in tokenfile.fetch(bad, dictionary, [600]).collect()] == [(600, ids(dict(rows)[600]))]
