"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

Everything is column expressions and DataFrame jobs; no Python runs on the executors. The model is
fitted to a small labelled table of URLs; where the caller has none, the pages that a rule decides are
that table, so that the verdict on other pages carries on what the rules say of hosts and paths like theirs.

Rows: null URLs, and those without ://, have empty host and path and get the model's verdict on them;
URLs of any length are taken whole; repeated rows are judged each, and count once in the labelled
table, as does each pair of URL and label; null labels are left out; null page ids are kept. Without
labels of both kinds every verdict that no rule gives is that of the only kind (none: allow). Tables
without rows give none."""

from __future__ import annotations

import json
import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelplan.llm.common import top_k

#: (verdict, host, path prefix); a fixed list given by the caller, not one that grows with the data.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BUCKETS = 2048
GRAMS = (3, 4)
#: At most so many labelled URLs of each label are fitted on: those whose hash is smallest.
TRAIN_ROWS = 2000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: the host runs from the first :// to /, ?, # or the end, A-Z lowered;
    the path from there to ?, # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or a parent domain of it and whose
    path starts the URL's path; null where none fits. Equal lengths: the first in the list."""
    rule = verdict = None
    for what, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def hashed_grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of all character n-grams of host and path, repeats included."""
    text = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        found = F.transform(places, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int"))  # a second parameter would be the index
        return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<int>"))

    return F.concat(*[of_length(n) for n in GRAMS])


def fit_url_model(labelled: DataFrame, buckets: int = BUCKETS, rows: int = TRAIN_ROWS) -> tuple[list[float], float]:
    """Weights and intercept from labelled URLs (url, label: 1 block, 0 allow).

    Fits on the `rows` distinct URLs of each label with the smallest hash, so that a label with few URLs
    is there beside one with very many. Without two classes, the weights are zero and the intercept's
    sign is that of the only class (none: allow)."""
    host, path = url_parts(F.col("url"))
    known = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label")).distinct()
    sample = top_k(known, ["label"], [F.xxhash64("url"), F.col("url")], rows, "place", spread=32)
    words = F.transform(F.array_distinct(hashed_grams(host, path, buckets)), lambda b: b.cast("string"))
    as_vectors = CountVectorizerModel.from_vocabulary([str(b) for b in range(buckets)], inputCol="words", outputCol="features").setBinary(True)  # bucket b is feature b
    train = as_vectors.transform(sample.select("label", words.alias("words"))).select("label", "features").persist()  # sparse, 2 x rows at most
    try:
        seen = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two classes at most
        if len(seen) < 2:
            return [0.0] * buckets, 5.0 if 1.0 in seen else -5.0
        total = sum(seen.values())
        weight = F.when(F.col("label") == 1, total / (2 * seen[1.0])).otherwise(total / (2 * seen[0.0]))
        model = LogisticRegression(maxIter=25, regParam=0.003, standardization=False, weightCol="weight").fit(train.withColumn("weight", weight))
        return [float(x) for x in model.coefficients], float(model.intercept)
    finally:
        train.unpersist()


def block_probability(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # a constant of fixed size
    grams = F.array_distinct(hashed_grams(host, path, len(weights)))
    logit = F.aggregate(grams, F.lit(intercept), lambda total, b: total + F.element_at(table, b + 1))
    return 1 / (1 + F.exp(-logit))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, p_block and verdict added (columns of these names are replaced).

    labelled (url, label) trains the model; without it, the pages that a rule decides are the
    labelled table. Null URLs have empty host and path and get the model's verdict."""
    host, path = url_parts(F.col("url"))
    parts = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    if labelled is None:
        labelled = parts.select("url", (verdict == "block").cast("double").alias("label")).filter("label is not null")
    weights, intercept = fit_url_model(labelled)
    scored = parts.withColumn("rule", rule).withColumn("p_block", block_probability(F.col("host"), F.col("path"), weights, intercept))
    return scored.withColumn("verdict", F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")))
