"""Quality rules: statistics by hand, robust estimates against a search with many random starts in numpy, odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelplan.llm")

from panelplan.llm import quality, registry
from panelplan.llm.common import table

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\x1c\x85", "a", "Ünï ① 'sé 👩‍👩‍👧 <x> x #*", "aaaa " * 3000, "the same words again and again " * 40, "a b\n\n a b\na b\r\nc\n \n", "x y z " * 4 + "other things stand here now " * 2]


def statistics(text: str | None) -> tuple:
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_equal_counting_by_hand(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    found = registry.op12_quality_rules(spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        want = statistics(texts[r["doc_id"]])
        assert tuple(r[c] for c in COLUMNS) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] <= (not r["base_failed"])


def test_repeated_words_of_random_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("ab" if k % 2 else "abcdef", k=rng.randrange(40))) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.with_statistics(docs).collect():
        assert tuple(r[c] for c in COLUMNS) == statistics(texts[r["doc_id"]])


def distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def mcd_by_force(x: np.ndarray, starts: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The reweighted estimate from the best of many random starts."""
    rng, ridge, best = np.random.default_rng(0), np.diag(np.square(quality.RIDGE)), None

    def of(rows: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        return rows.mean(axis=0), quality.consistency(share) * np.cov(rows.T, bias=True) + ridge

    cover = quality.COVER / 100
    for _ in range(starts):
        mean, cov = of(x[rng.choice(len(x), 8, replace=False)], cover)
        for _ in range(30):
            bins = np.floor(quality.BINS * np.log2(1 + distances(x, mean, cov)))
            last = np.sort(bins)[int(np.ceil(cover * len(x))) - 1]
            mean, cov = of(x[bins <= last], cover)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, mean, cov
    near = distances(x, best[1], best[2]) <= quality.chi_square_quantile(quality.REWEIGHT, 5)
    return of(x[near], quality.REWEIGHT)


@pytest.mark.parametrize("rows", [quality.BROADCAST_ROWS, 0])
def test_estimates_equal_many_random_starts(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(3)
    groups = {}
    for name, n, bad in (("a", 400, 80), ("b", 150, 0), ("c", 90, 18)):
        mixed = rng.normal(size=(n, 5)) @ np.diag([0.8, 0.1, 0.02, 0.1, 0.05]) @ (np.eye(5) + 0.3 * rng.normal(size=(5, 5)))
        mixed[:bad] = [1.0, 0.7, 0.6, 0.5, 0.4] + 0.05 * rng.normal(size=(bad, 5))  # a cluster of junk
        groups[name] = np.round(quality.UNIT * mixed).astype(np.int64)
    rows = [("en", name, *row, 1) for name, x in groups.items() for row in x.tolist()]
    vectors = spark.createDataFrame(rows, "lang string, source string, x0 long, x1 long, x2 long, x3 long, x4 long, n long")
    vectors = vectors.groupBy("lang", "source", *quality.X).agg(F.sum("n").alias("n"))
    found = {r["source"]: r for r in quality.robust_estimates(vectors).collect()}
    assert set(found) == set(groups)
    for name, x in groups.items():
        mean, cov = mcd_by_force(x / quality.UNIT)
        r = found[name]
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose([r[f"m{i}"] for i in range(5)], mean, atol=1e-6) and np.allclose(low @ low.T, cov, atol=1e-6)
        far = distances(x / quality.UNIT, mean, cov) > quality.chi_square_quantile(quality.CUTOFF, 5)
        if name != "b":
            assert far[: {"a": 80, "c": 18}[name]].all() and far.sum() <= {"a": 80, "c": 18}[name] + 2


def test_quantiles():
    assert quality.chi_square_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert quality.chi_square(14.067, 7) == pytest.approx(0.95, abs=1e-4)


def test_junk_is_rejected_and_clean_documents_stay(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    judged = registry.op12_quality_rules(spark, "/root/testdata/sf0.01").join(labels.groupBy("doc_id").agg(F.min("quality").alias("q")), "doc_id").filter("not base_failed")
    share = {r["q"]: r["k"] for r in judged.groupBy("q").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.2
    assert docs.count() == registry.op12_quality_rules(spark, "/root/testdata/sf0.01").count()


def test_quality_odd_rows(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(ODD)] + [(None, "no id " * 9, None, None), (3, "again " * 3, "de", None), (3, "again " * 3, "de", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("x0", F.lit("x")).withColumn("n", F.lit(1)).withColumn("id", F.lit("y"))
    found = quality.judge_quality(odd).collect()
    assert Counter(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in found) == Counter((k, *statistics(t)) for k, t, _, _ in rows)
    assert quality.judge_quality(odd.filter("false")).count() == 0
    alone = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)), "en", "s")], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in quality.judge_quality(alone).collect()] == [True]
