"""Exact dedup against plain computations: one batch, batches against a kept index, repeated runs, odd rows."""

import collections
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from beatspark.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, digest string, at int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a"), (9, "a"), (9, "a"), (None, "a"), (None, "b"), (None, "b"), (4, "A"), (5, "a "), (6, "é" * 50_000), (7, "é" * 50_000)]


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def plain(rows, keep=max):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, done = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        named = [x for x in ids if x is not None]
        best = keep(named) if named else None
        kept = i == best and (t or "") not in done
        if kept:
            done.add(t or "")
        out.append((i, best, len(ids), kept, sha(t)))
    return sorted(out, key=str)


def answer(found):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in found.collect()), key=str)


def test_one_batch(spark):
    for keep, least in (("largest", max), ("smallest", min)):
        index = exact_dedup.DigestIndex(spark, buckets=4)
        assert answer(exact_dedup.add(index, rows_of(spark, ODD), "b1", keep=keep)) == plain(ODD, least)
        assert index.entries().count() == len({t or "" for _, t in ODD})
        index.drop()


def test_batches_against_the_kept_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, buckets=3)
    first = [(1, "a"), (5, "a"), (2, "b"), (3, None)]
    assert answer(exact_dedup.add(index, rows_of(spark, first), "b1")) == plain(first)
    second = [(8, "a"), (9, "c"), (7, "c"), (4, ""), (6, "d")]
    for _ in range(2):  # the second time it is started again
        reopened = exact_dedup.DigestIndex(spark, path)
        assert reopened.buckets == 3
        found = exact_dedup.add(reopened, rows_of(spark, second), "b2").collect()
        assert {(r.id, r.keep_id, r.group_size, r.seen_before, r.kept) for r in found} == {
            (8, 5, 1, True, False), (9, 9, 2, False, True), (7, 9, 2, False, False), (4, 3, 1, True, False), (6, 6, 1, False, True)}
        assert reopened.entries().count() == 5
    reopened.compact()
    assert {r.digest.hex() for r in reopened.entries().collect()} == {sha(t) for t in ("a", "b", "", "c", "d")}
    assert {r.id for r in exact_dedup.add(reopened, rows_of(spark, [(20, "d"), (21, "e")]), "b3").where("kept").collect()} == {21}
    with pytest.raises(ValueError):
        exact_dedup.add(reopened, rows_of(spark, second), "b'3")


def test_index_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.add(index, rows_of(spark, ODD), "b1").count()
    plan = index.new(index.entries().select("digest"), "b2")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    index.drop()


def test_new_documents_keeps_columns(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    kept = exact_dedup.new_documents(index, rows_of(spark, ODD), "b1")
    assert kept.columns == ["doc_id", "text", "digest", "at"]
    got = sorted(((r.doc_id, sha(r.text)) for r in kept.collect()), key=str)
    assert got == sorted(((i, h) for i, _, _, k, h in plain(ODD) if k), key=str)
    assert exact_dedup.new_documents(index, rows_of(spark, ODD).limit(0), "b2").count() == 0
    index.drop()


def test_hot_text(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), (F.col("id") % 30_000).cast("string"))).alias("text"))
    index = exact_dedup.DigestIndex(spark, buckets=4)
    found = exact_dedup.add(index, docs, "b1")
    one = found.where(F.col("digest") == exact_dedup.digest(F.lit("same"))).agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.min("group_size"), F.max("keep_id")).first()
    assert tuple(one) == (20_000, 1, 20_000, 59_997)
    assert found.where("kept").count() == 1 + 20_000
    index.drop()


def test_query_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(map(str, c.sql(queries.ORACLES["op11_exact_dedup"]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES["op11_exact_dedup"](spark, SF).collect()) == want
