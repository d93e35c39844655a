"""Corpus pipeline: documents pass five stages in order.

Each stage gets all rows that its predecessor kept; the rows are written to the shared folder and
read again as the next stage's documents. All but the last return the columns of documents.

Rows: each is kept or dropped for its own text, also where ids are null or repeat; null texts are kept
as they are by the filters and are empty after the passages are cut; columns beyond those of documents
are carried on; tables without rows give none."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelplan.llm.bpe import bpe_encode_checked
from panelplan.llm.common import table
from panelplan.llm.decontaminate import benchmark_hits
from panelplan.llm.repeats import repeats_removed
from panelplan.llm.simhash import near_duplicates_removed
from panelplan.llm.toxicity import score_toxicity, train_toxicity
from panelplan.sources.scratch import remove, scratch_dir, staged, temporary

VOCABULARY = "byte_bpe_50k.json"
#: Passages of over 50 words are to go; words here have 5 letters and more on average, so that 51 of them take 256 bytes at least.
PASSAGE_BYTES, PASSAGE_GRAM = 256, 64


def _carried(docs: DataFrame) -> DataFrame:
    """(row, text): a verdict then stays with its row, also where ids are null or repeat."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores 0.5 or more go; it learns from all labels that are there."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(_carried(docs), model, "row", keep_text=True).filter("score < 0.5").select("row.*", "text").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with linked SimHash fingerprints, that with the smallest id stays; so do all with a null id."""
    return near_duplicates_removed(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the passages of PASSAGE_BYTES bytes or more that also begin elsewhere, n_chars is that of what is left.

    The operator's own query keeps to 400 bytes, by its contract; the stage has a length of its own."""
    rows = _carried(docs).withColumn("doc_id", F.col("row.doc_id"))
    left = repeats_removed(rows, size=PASSAGE_BYTES, gram=PASSAGE_GRAM).select("row.*", F.col("kept").alias("text"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is inside windows of benchmark items go."""
    hits = benchmark_hits(_carried(docs), table(spark, sf_dir, "benchmark"), "row", keep_text=True)
    return hits.filter("not contaminated").select("row.*", "text").select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as token ids; `lossless` tells whether they decode to the text."""
    found = bpe_encode_checked(docs, public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode_tokens),
]

#: Scores of a fitted model, fingerprints and merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages. What a stage wrote on its way goes when its rows are written, and those when the
    next stage's are, so that at the end the rows before the last stage are left, which the result is read from."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"stage-{name}")
        with temporary(spark):
            docs = staged(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
