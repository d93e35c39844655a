"""The pipeline leaves the rows before its last stage and nothing else."""

from __future__ import annotations

import os

import pytest

pytest.importorskip("panelplan.llm")

SMALL = "/root/testdata/sf0.001"


def test_a_run_leaves_its_last_stage_only(spark):
    import corpus_pipeline

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    found = corpus_pipeline.run(spark, SMALL)
    left = set(os.listdir(base)) - before
    assert found.count() > 100 and len(left) == 1 and left.pop().startswith("stage-benchmark_decontamination")
