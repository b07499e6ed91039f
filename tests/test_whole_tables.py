"""Queries that must answer every row of their table, against plain Python on a small one."""

import re
import unicodedata
from collections import Counter
from datetime import datetime, timedelta

from quillstone.plans import catalog, records


def test_documents_of_any_length_are_answered(spark, tmp_path):
    long = "(Wort) «zwei» [drei] co­op a​b\n" * 400
    rows = [(1, "(a) <b>\nzwei", 12), (2, long, len(long)), (3, "{x} co­op\n\n", None), (4, "", 0), (5, None, None)]
    spark.createDataFrame([(i, t, "en", "src0", n) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    mirror = str.maketrans("()[]{}<>«»", ")(][}{><»«")
    want = {
        "fn_mirror": lambda t: t.translate(mirror),
        "inj_strip": lambda t: "".join(c for c in t if unicodedata.category(c) != "Cf"),
        "fn_ocr_text": lambda t: t,
        "fn_join_lines": lambda t: re.sub("([A-Za-z])[-‐]\n([a-z])", r"\1\2", t.replace(" ", "-\n")),
    }
    for name, f in want.items():
        got = {r.doc_id: r.text for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {i: None if t is None else f(t) for i, t, _ in rows}, name


def test_every_event_is_a_job(spark, tmp_path):
    now = datetime.fromisoformat(records.NOW)
    rows = [(k, now - timedelta(days=k % 6, hours=1), k % 30) for k in range(400)]
    spark.createDataFrame([(*r, "view", 1.0, "{}") for r in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    held = {k: k % 3 == 0 and ts + timedelta(days=4) > now for k, ts, _ in rows}
    live = Counter(u % 10 for k, _, u in rows if held[k])
    want = {}
    for k, ts, u in rows:
        said = "held" if held[k] else "parked" if k % 4 == 0 and ts + timedelta(days=3) > now else "busy" if live[u % 10] >= 45 else "acquired"
        want[k] = (said, k % 5 + (said == "acquired" and k % 3 == 0))
    assert {r.event_id: (r.outcome, r.attempts_after) for r in catalog.queries()["st_lease"](spark, str(tmp_path)).collect()} == want


def test_every_document_gives_a_title(spark, tmp_path):
    rows = [(k, f"{'abcdefghij'[k] * 5} first line\nsecond", "en", "src0", 30) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.page, r.title, r.block) for r in catalog.queries()["jn_outline"](spark, str(tmp_path)).collect()}
    assert got == {(k % 5, "abcdefghij"[k] * 5, k) for k in range(10)}
