"""Copies of a frequent payload are dealt to several tasks, with the same archives."""

from __future__ import annotations

import pytest

pytest.importorskip("panelplan.llm")

from pyspark.sql import functions as F

from panelplan.llm import warc
from panelplan.llm.common import shared_dir


def _pages(spark):
    """Two frequent payloads (400 and 90 copies), single ones, small and null ones, a repeated row and null ids."""
    texts = {0: "a" * 200, 1: "b" * 300}
    rows = [(k, f"http://h/{k}", texts[0] if k % 5 < 4 else texts[1] if k < 450 else f"single {k} " * 20) for k in range(500)]
    rows += [(500, None, ""), (501, "http://h/501", None), (0, "http://h/0", texts[0]), (None, "http://h/x", texts[0]), (None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def _expected(rows):
    smallest = {}
    for page, _, html in rows:
        if page is not None and len(html or "") >= 100:
            smallest[html] = min(page, smallest.get(html, page))
    out = []
    for page, _, html in rows:
        to = smallest.get(html) if [r[2] for r in rows].count(html) > 1 else None
        out.append((page, "response", None) if to is None or page == to else (page, "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [500, 10_000, 1 << 24])
@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_shares_of_frequent_payloads_give_the_same_records(spark, share, threshold):
    """Both where the table of firsts is small enough for Spark to broadcast it, and where payloads are shuffled by share."""
    pages, rows = _pages(spark)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, threshold)
    try:
        files = warc.write_warc(pages, shared_dir(spark, "warc"), share_bytes=share)
    finally:
        spark.conf.set(name, before)
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(files).collect()]
    assert sorted(got, key=str) == _expected(rows)


@pytest.mark.parametrize("widest", [1, 2])
def test_only_the_widest_keys_are_spread(spark, widest):
    pages, _ = _pages(spark)
    rows = pages.filter("length(html) >= 100").select("page_id", "url", F.sha2("html", 256).alias("key"))
    groups = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = groups.select("key", "first", F.ceil(F.col("n") / 20).alias("shares"))
    joined = warc._joined_in_shares(rows, first, widest)
    assert joined.count() == rows.count()
    shares = sorted(r.n for r in joined.filter("first is not null").groupBy("key").agg(F.count_distinct("__share").alias("n")).collect())
    assert shares == ([1, 21] if widest == 1 else [5, 21])
