"""Hot payloads, long books and texts of very many notices."""

import collections
import time

import duckdb
from pyspark.sql import functions as F

from beatspark.llm import license_scan, packing, queries, warc


def test_payload_of_a_third_of_all_pages(spark):
    rows = [(k, f"u{k % 5}", "same" if k % 3 == 0 else f"own {k}") for k in range(600)] + [(7, "u", "long " * 9000)] * 4 + [(None, "u", "same")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    planned = warc.plan(frame)
    assert planned.where("refers_key IS NOT NULL").count() == 200
    named = {r.key for r in planned.select("key").collect()}
    assert {r.refers_key for r in planned.where("refers_key IS NOT NULL").collect()} <= named
    back = warc.reassemble(warc.read(spark, warc.archive(frame, 0, 1000))).collect()
    assert len(back) == len(rows) and all(r.whole for r in back)
    assert collections.Counter(r.type for r in back) == {"revisit": 200, "response": 405}
    assert sum(r.page_id == 7 and r.payload == b"long " * 9000 for r in back) == 4


def test_what_was_read_back_is_compared_with_its_header(spark):
    frame = spark.createDataFrame([(1, "u", "abcdef"), (2, "u", "xyz")], "page_id bigint, url string, html string")
    segments = warc.read(spark, warc.archive(frame))
    changed = segments.withColumn("block", F.when(F.col("page_id") == 1, F.encode(F.replace(F.decode("block", "UTF-8"), F.lit("abcdef"), F.lit("abcdeX")), "UTF-8")).otherwise(F.col("block")))
    assert {r.page_id: r.whole for r in warc.reassemble(changed).collect()} == {1: False, 2: True}


def test_books_of_many_pieces_are_not_packed(spark):
    pieces = [(d, p, 2048 if p < 400 else 100 + d) for d in range(12) for p in range(401)] + [(99, 0, 50)] * 30
    got = packing.pack(spark.createDataFrame(pieces, "doc_id bigint, piece int, length bigint"), group=10).collect()
    assert collections.Counter((r.doc_id, r.piece, r.length) for r in got) == collections.Counter(pieces)
    full = [r for r in got if r.length == 2048]
    assert len({r.sequence_id for r in full}) == len(full) == 4800 and all(r.offset == 0 for r in full)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) - 4800 <= 8  # five groups of ten pieces or less


def test_a_text_of_two_thousand_notices(spark):
    notice = next(t for t in license_scan.NOTICES if t.name == "mit-short").text
    rows = [(1, " and ".join([notice] * 2000)), (2, notice.replace("free of charge", "free charge") + " x " + notice)]
    began = time.time()
    got = {r.doc.doc_id: r.spans for r in license_scan.spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    took = time.time() - began
    k = [t.name for t in license_scan.PHRASES + license_scan.NOTICES].index("mit-short")
    n = len(notice.split())
    mine = [s for s in got[1] if s.template == k]
    assert [(s.first, s.last) for s in mine] == [(at, at + n - 1) for at in range(0, 2000 * (n + 1), n + 1)] and all(s.share == 1.0 for s in mine)
    assert len([s for s in got[2] if s.template == k]) == 2
    assert took < 120


def test_warc_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = c.sql(queries.ORACLES["op6_warc"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.QUERIES["op6_warc"](spark, sf).collect()) and want
