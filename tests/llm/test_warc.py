"""Archives bounded by bytes; revisits resolved on headers."""

import gzip
from pathlib import Path

from pyspark.sql import functions as F

from daygrid import session
from daygrid.llm import warc


def opened(folder):
    return [gzip.decompress(p.read_bytes()) for p in Path(folder.removeprefix("file:")).glob("*.gz")]


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    # a few pages a thousand times as large as the others, all in one task
    rows = [(i, "u", chr(97 + i % 26) * (40_000 if i % 10 == 0 else 45 if i != 7 else 200_000)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    source = warc.archive_pages(pages)
    archives = opened(source)
    assert all(len(a) <= 50_000 or a.count(b"WARC/1.1\r\n") == 1 for a in archives)
    assert sum(len(a) > 50_000 for a in archives) == 1 and len(archives) < 60
    assert {r["page_id"]: r["payload"].decode() for r in warc.read_archives(spark, source).collect()} == {i: h for i, _, h in rows}


def resolved(spark, pages):
    rows = warc.read_archives(spark, warc.deduplicated_archives(spark, warc.archive_pages(pages))).collect()
    return sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload"]) for r in rows)


def test_verdicts_meet_their_archives_either_way(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(i, "u", f"copy {i % 7 if i % 3 else 0} ".ljust(2_000, "x") if i % 11 else f"own {i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    top = {}
    for i, _, h in rows:
        top[h] = max(i, top.get(h, i))
    want = sorted((i, "response", None, h.encode()) if top[h] == i or len(h) < 1000 else (i, "revisit", top[h], None) for i, _, h in rows)
    assert resolved(spark, pages) == want
    monkeypatch.setattr(warc, "bounded", lambda df: session.durable(df))  # as if too large for a broadcast
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_001)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert resolved(spark, pages) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_revisits_in_the_input_are_rewritten(spark):
    page = "p" * 1500
    digest = "0" * 40
    rows = [(1, "u", "response", None, None, 1500, page.encode()), (2, "u", "revisit", 9, digest, 1500, None), (3, "u", "response", None, None, 1500, page.encode())]
    frame = spark.createDataFrame(rows, warc.SCHEMA).withColumn("payload_digest", F.coalesce("payload_digest", F.sha1("payload")))
    path = session.fresh_path(spark, "given")
    warc.write_archives(frame, path)
    out = warc.archived(spark, warc.deduplicated_archives(spark, path)).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, out)) == [(1, "revisit", 3), (2, "revisit", 9), (3, "response", None)]


def test_no_payload_is_shuffled(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "write_archives", lambda records, path: seen.append(records))
    source = session.fresh_path(spark, "given")
    spark.range(1).select(F.lit("WARC/1.1\r\nContent-Length: 0").alias("value")).write.text(source)
    monkeypatch.setattr(warc, "parse", lambda data: iter(()))
    warc.deduplicated_archives(spark, source)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
