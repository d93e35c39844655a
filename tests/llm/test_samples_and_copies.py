"""Training samples without size switches and of bounded size, many repeated rows, and benchmarks of many shards."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelplan.llm")

from panelplan.llm import decontaminate, language, repeats, toxicity
from panelplan.llm.common import table

SMALL = "/root/testdata/sf0.001"


def prose(letters: str, n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_a_language_of_long_documents_only_is_learned(spark):
    rows = [(k, prose("abcde", 40, k), "aa") for k in range(40)] + [(100 + k, prose("vwxyz", 8000, 100 + k), "bb") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.reference_texts(docs)
    shortest = min((r[1] for r in rows if r[2] == "bb"), key=len)
    assert len(shortest) >= language.REFERENCE_BYTES and found["bb"] == shortest.encode() + b"\n"
    got = language.identify_language(docs, found).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_rows_of_one_id_do_not_all_reach_the_driver(spark, monkeypatch):
    many = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("some words here "), (F.col("id") % 3).cast("string")).alias("text"), F.lit("en").alias("lang"))
    sizes, collect = [], type(many).collect
    monkeypatch.setattr(type(many), "collect", lambda self: (sizes.append(len(rows := collect(self))), rows)[1])
    assert len(language.reference_texts(many)["en"].splitlines()) == 3
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(many.unionByName(spark.createDataFrame([(8, "x y", "en")], many.schema)), labels)
    assert sorted((r["y"], r["text"]) for r in rows) == [(0, "x y"), *[(1, f"some words here {k}") for k in range(3)]]
    assert max(sizes) <= language.REFERENCE_DOCS


def test_a_class_of_long_documents_only_is_learned(spark):
    toxic = [(k, prose("abcde", 3000, k) + " vileword" * 30, "en") for k in range(30)]
    clean = [(100 + k, prose("abcde", 60, 100 + k), "en") for k in range(40)]
    assert min(len(r[1]) for r in toxic) > toxicity.SAMPLE_CHARS
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1) for r in toxic] + [(r[0], 0) for r in clean], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()}
    assert min(scores[r[0]] for r in toxic) > 0.5 > max(scores[r[0]] for r in clean)
    few = toxicity.labelled_sample(docs, labels, per_class=2, chars=9000)
    assert [r["y"] for r in few].count(1) == 1 and [r["y"] for r in few].count(0) == 2  # one whole text, beyond the class's characters


def test_a_text_with_both_labels_teaches_nothing(spark):
    docs = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "bad"), (4, "good"), (5, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    assert [(r["id"], r["y"]) for r in toxicity.labelled_sample(docs, labels)] == [(3, 1), (4, 0)]


@pytest.mark.parametrize("part", [repeats.PART_BYTES, 300])
def test_many_copies_of_a_row_have_their_spans_once(spark, part):
    shared, other = prose("abc", 60, 1), prose("abc", 40, 2)
    rows = [(1, f"{shared} {other}")] * 600 + [(None, shared)] * 300 + [(2, f"x {shared} y"), (3, prose("xyz", 60, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = repeats.repeat_spans(docs, size=40, gram=16, part_bytes=part)
    assert max(r.n for r in spans.select(F.size("spans").alias("n")).collect()) < 400
    left = {(r.doc_id, r.kept) for r in repeats.repeats_removed(docs, size=40, gram=16, part_bytes=part).collect()}
    x = rows[-2][1]
    gone = {i + k for i in range(len(x) - 39) if x[i : i + 40] in f"{shared} {other}" or x[i : i + 40] in shared for k in range(40)}
    assert left == {(1, ""), (None, ""), (2, "".join(c for k, c in enumerate(x) if k not in gone)), (3, rows[-1][1])}


def test_many_shards_write_no_documents(spark, monkeypatch):
    docs, bench = table(spark, SMALL, "documents").select("doc_id", "text"), table(spark, SMALL, "benchmark")
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    one = {tuple(r) for r in decontaminate.benchmark_hits(docs, bench).drop("items").collect()}
    many = decontaminate.shard_files(bench, limit=100)
    assert len(many) > 8
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 50_000)
    assert {tuple(r) for r in decontaminate.benchmark_hits(docs, bench, shard_windows=100).drop("items").collect()} == one
    new = set(os.listdir(base)) - before
    assert new and all(name.startswith("shards") for name in new)
