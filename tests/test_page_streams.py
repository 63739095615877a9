"""Keyed state on streams: flushes, tombstones, stalls, restarts; and feedback that meets its request or does not."""

import datetime as dt
import uuid

from quillspark.streaming import feedback as W
from quillspark.streaming import pages as P
from quillspark.tables import shared_dir

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def page(doc, n, total, text="some text", error=None, seq=None, minutes=0):
    return (doc, float(n if seq is None else seq), T0 + dt.timedelta(minutes=minutes), n, total, text, error)


def tombstone(doc, seq):
    return (doc, float(seq), T0, None, None, None, None)


def add(spark, path, rows):
    spark.createDataFrame(rows, P.PAGES).coalesce(1).write.mode("append").parquet(path)


def states(spark, root):
    return {r["doc_id"]: tuple(r)[1:] for r in P.page_states(spark, f"{root}/out").collect()}


def run(spark, root, **named):
    query = P.ingest_pages(spark, f"{root}/in", f"{root}/out", f"{root}/progress", lambda t: t.split("|") if t else [], every=5, **named)
    assert query.awaitTermination(240)


def test_flushes_partial_restart_and_end(spark):
    root = folder(spark)
    add(spark, f"{root}/in", [page(1, n, 12, f"a{n}|b{n}") for n in range(1, 8)] + [page(2, n, 3, error="torn") for n in (1, 2)] + [page(3, 1, 40)])
    run(spark, root)
    # 1 has been flushed once, 2 and 3 have no state to show yet
    assert states(spark, root) == {1: ("PARTIAL", 5, 12, 0, 10)}
    assert {(r["doc_id"], r["page"]) for r in P.searchable_chunks(spark, f"{root}/out").collect()} == {(1, n) for n in range(1, 6)}
    assert [tuple(r) for r in P.disclosure(P.page_states(spark, f"{root}/out")).collect()] == [(1, "searched 5 of 12 pages")]
    # a new query from the checkpoint goes on with pages 6 and 7 still in its state; a page comes twice
    add(spark, f"{root}/in", [page(1, n, 12, f"a{n}|b{n}") for n in (7, 8, 9, 10, 11, 12)] + [page(2, 3, 3, "fine")])
    run(spark, root)
    got = states(spark, root)
    assert got[1] == ("READY", 12, 12, 0, 24) and got[2] == ("FAILED", 3, 3, 2, 1)
    rows = [(r["doc_id"], r["page"], r["chunk_idx"], r["text"]) for r in P.searchable_chunks(spark, f"{root}/out").collect()]
    assert sorted(rows) == sorted((1, n, i, f"{c}{n}") for n in range(1, 13) for i, c in enumerate("ab"))


def test_tombstones_stop_at_the_next_page(spark):
    root = folder(spark)
    add(spark, f"{root}/in", [page(1, n, 20) for n in range(1, 9)] + [tombstone(1, 6.5), tombstone(2, 3.5)] + [page(2, n, 3) for n in (1, 2, 3)])
    add(spark, f"{root}/in", [page(1, n, 20) for n in range(9, 21)])
    run(spark, root)
    got = states(spark, root)
    assert got[1] == ("CANCELLED", 6, 20, 0, 5)  # page 6 was read, but not flushed
    assert got[2] == ("READY", 3, 3, 0, 3)  # it had ended
    assert {r["doc_id"] for r in P.searchable_chunks(spark, f"{root}/out").collect()} == {2}


def test_stalled_documents_fail_with_what_they_have(spark):
    root = folder(spark)
    for rows in ([page(1, 1, 9)], [page(9, 1, 2, minutes=300)], [page(9, 2, 2, minutes=301)]):
        add(spark, f"{root}/in", rows)
        run(spark, root, files_per_batch=1, stall_ms=60_000)
    got = states(spark, root)
    assert got[1] == ("FAILED", 1, 9, 0, 1) and got[9][0] == "READY"


def test_feedback_meets_its_request(spark):
    root = folder(spark)
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    requests = [[(1, at(0), "a"), (2, at(1), "b"), (3, at(2), "c")], [(4, at(200), "d")], [(5, at(20), "too late")], [(99, at(10_000), "end")]]
    said = [[(1, at(30), 1), (1, at(40), -1), (2, at(90), 1)], [(4, at(199), 1), (3, at(2), 1)], [(4, at(210), 1)], [(98, at(10_000), 1)]]
    for r, f in zip(requests, said):
        spark.createDataFrame(r, "trace_id long, ts timestamp, status string").coalesce(1).write.mode("append").parquet(f"{root}/requests")
        spark.createDataFrame(f, "trace_id long, feedback_ts timestamp, thumb int").coalesce(1).write.mode("append").parquet(f"{root}/feedback")
        assert W.follow_feedback(spark, f"{root}/requests", f"{root}/feedback", f"{root}/out", f"{root}/progress").awaitTermination(240)
    rows = {r["trace_id"]: (r["status"], r["thumb"]) for r in W.request_rows(spark.read.parquet(f"{root}/out")).collect()}
    rows.pop(99, None)
    # the newest feedback in time counts; none of before its request, or of over an hour later; a row behind the watermark is dropped
    assert rows.pop(3) in (("c", 1), ("c", None))  # its feedback may come behind the watermark, too
    assert rows == {1: ("a", -1), 2: ("b", None), 4: ("d", 1)}


def test_late_request_rows_change_no_feedback(spark):
    rows = [(1, T0, "answered", T0, 1), (1, T0 + dt.timedelta(hours=1), "error", None, None), (2, T0, "x", None, None)]
    frame = spark.createDataFrame(rows, "trace_id long, ts timestamp, status string, feedback_ts timestamp, thumb int")
    assert {r["trace_id"]: (r["status"], r["thumb"]) for r in W.request_rows(frame).collect()} == {1: ("error", 1), 2: ("x", None)}
