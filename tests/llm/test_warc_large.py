"""A payload of several read pieces between small records."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("panelplan.llm")

from panelplan.llm import warc
from panelplan.llm.common import shared_dir


@pytest.mark.parametrize("split", [1 << 16, 1 << 20, 1 << 22])
def test_a_large_payload_is_read_whole_and_once(spark, split):
    rng = random.Random(split)
    large = "".join(map(chr, rng.choices(range(32, 700), k=1_800_000)))
    rows = [(k, "http://a/", large if k == 7 else f"<p>{k}</p>" * 30) for k in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: bytes(r.payload) for r in warc.read_warc(warc.write_warc(pages, shared_dir(spark, "warc")), split).collect()}
    assert got == {k: html.encode() for k, _, html in rows} and len(got[7]) > 3_000_000
