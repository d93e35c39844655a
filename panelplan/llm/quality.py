"""Quality rules: base rules on text statistics, and robust multivariate outliers within language and source.

Everything is column expressions and DataFrame jobs; no Python runs on the executors. Each document has five
statistics (words, their mean length, the shares of symbols, of repeated lines and of words in repeated
windows), transformed by logarithms and roots. For each language and source the minimum covariance
determinant is estimated over all its documents that pass the base rules: from STARTS first estimates (all
documents, and ELEMENTS distinct vectors chosen by hash), concentration steps take the COVER percent of the
documents that are nearest by Mahalanobis distance and estimate mean and covariance anew; the start of least
determinant after two steps goes on until nothing changes. As usual, documents within the 97.5 % quantile then
give the last, reweighted estimate, and those beyond the CUTOFF quantile are rejected.

A step is one pass: moments are added up by group and bin of the distance (BINS to a doubling), and the nearest
documents are the first bins that hold COVER percent. Vectors are whole numbers of 1 / UNIT, so sums do not
depend on their order and a repeated task finds the same; equal vectors are one row with a count. The driver
gets one number a step. Statistics that most documents share (no symbols) leave no variance, so RIDGE, a
standard deviation for each statistic, is added to the covariances: the regularized form of the estimate. Groups of
few documents are mostly judged by it.

Sums hold up to 3e10 documents of a group. Rows: a null text has no words; null languages and sources are one group with
the empty ones; rows with a null or repeated id are judged each; documents that fail the base rules teach
nothing and are not kept; tables without rows give none. Other columns are not read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelplan.llm.common import let, replaced, top_k, written
from panelplan.sources.scratch import discard

BLANK_PATTERN = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
UNIT, BINS, COVER, STARTS, ELEMENTS, MAX_STEPS = 1024, 32, 75, 5, 8, 30
BROADCAST_ROWS, SALTS = 50_000, 32
#: Standard deviations added to those of: log of words, log of mean word length, roots of the shares of symbols, repeated lines, repeated words.
RIDGE = (0.5, 0.1, 0.05, 0.15, 0.15)
REWEIGHT, CUTOFF = 0.975, 0.99999
KEYS = ["lang", "source"]
X = [f"x{i}" for i in range(len(RIDGE))]
PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words are in windows of consecutive words that the list holds twice or more.

    Windows of unique hash are out; the others are compared as strings, next to each other in their order."""
    size = F.size(words)
    starts = F.when(size >= window, F.sequence(F.lit(0), size - window)).otherwise(F.array().cast("array<int>"))

    def among(starts: Column) -> Column:
        found = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, window), " ").alias("text"), i.alias("at")))

        def places(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k - 1)["text"] == x["text"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["text"] == x["text"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        zero = F.struct(F.lit(-window).alias("before"), F.lit(0).alias("n"))
        return F.aggregate(let(F.sort_array(found), places), zero, lambda t, i: F.struct(i.alias("before"), (t["n"] + F.least(F.lit(window), i - t["before"])).alias("n")), lambda t: t["n"])

    def hashed(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(among(starts))

    return let(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, window))), hashed).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BLANK_PATTERN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHARACTER))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = docs.withColumns({"__words": of_words, "__lines": of_lines, "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
    return found.select(*[c for c in found.columns if not c.startswith("__")], "__words.*", "__lines.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))


def with_vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics x0 to x4, in whole numbers of 1 / UNIT."""
    words = F.greatest("n_words", F.lit(1))
    found = [F.log(words), F.log(F.greatest("word_chars", F.lit(1)) / words), _share("n_symbols", "word_chars"), _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")]
    return stats.withColumns({x: F.round(UNIT * v).cast("long") for x, v in zip(X, found, strict=True)})


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an odd number of degrees of freedom."""
    found = math.erf(math.sqrt(x / 2))
    for k in range(1, degrees, 2):
        found -= math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
    return found


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 1e-9, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest `share` of normal vectors is multiplied by."""
    return share / chi_square(chi_square_quantile(share, len(X)), len(X) + 2)


_SUMS = ["n", *[f"s{i}" for i in range(len(X))], *[f"s{i}{j}" for i, j in PAIRS]]


def _moments() -> list[Column]:
    n = F.col("n")
    return [F.sum(n).alias("n"), *[F.sum(n * F.col(x)).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(n * F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i, j in PAIRS]]


def _estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means, the Cholesky factor of the covariance (times factor, with RIDGE) and its log determinant, from sums."""
    out = sums.select(*keys, *[(F.col(f"s{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(len(X))], *[(F.col(f"s{i}{j}") / F.col("n") / UNIT**2).alias(f"s{i}{j}") for i, j in PAIRS])
    for i, j in PAIRS:
        left = factor * (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (RIDGE[i] ** 2 if i == j else 0.0)
        for k in range(j):
            left -= F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(len(X))), F.lit(0.0))
    return out.withColumn("logdet", F.round(logdet, 9)).drop(*[f"s{i}{j}" for i, j in PAIRS])


def _with_distance(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """vectors with d2, the squared Mahalanobis distance from each estimate of their group.

    estimates is a written table. It is broadcast if it has BROADCAST_ROWS rows at most; else groups are joined in
    SALTS shares, by the vector's hash, as one group may hold most vectors."""
    if estimates.count() <= BROADCAST_ROWS:
        out = vectors.join(F.broadcast(estimates), KEYS)
    else:
        shares = estimates.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = vectors.withColumn("__share", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")).join(shares, [*KEYS, "__share"]).drop("__share")
    for i, x in enumerate(X):
        left = F.col(x) / UNIT - F.col(f"m{i}")
        for k in range(i):
            left -= F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", left / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(X))), F.lit(0.0))).drop(*[f"z{i}" for i in range(len(X))])


def _concentrated(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step of every start."""
    keys = [*KEYS, "start"]
    binned = _with_distance(vectors, estimates).withColumn("bin", F.floor(BINS * F.log2(1 + F.col("d2"))))
    sums = binned.groupBy(*keys, "bin").agg(*_moments())
    nearer = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sums.withColumn("nearer", nearer).withColumn("all", F.sum("n").over(Window.partitionBy(*keys))).filter(100 * F.col("nearer") < COVER * F.col("all"))
    return written(_estimate(chosen.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS]), keys, consistency(COVER / 100)), "estimates")


def robust_estimates(vectors: DataFrame, steps: int = MAX_STEPS) -> DataFrame:
    """The reweighted minimum-covariance-determinant estimate of each language and source.

    vectors: KEYS, X and n, how many documents have the vector; read once a step."""
    keys, factor = [*KEYS, "start"], consistency(COVER / 100)
    drawn = vectors.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
    drawn = top_k(drawn, keys, [F.xxhash64("start", *X), *X], ELEMENTS).withColumn("n", F.lit(1).cast("long"))
    first = vectors.withColumn("start", F.lit(0)).groupBy(*keys).agg(*_moments()).unionByName(drawn.groupBy(*keys).agg(*_moments()))
    found = written(_estimate(first, keys, factor), "estimates")
    for _ in range(2):
        before, found = found, _concentrated(vectors, found)
        discard(before)
    found = replaced(found, top_k(found, KEYS, ["logdet", "start"], 1).drop("rank"), "estimates")
    for _ in range(steps):
        now = _concentrated(vectors, found)
        moved = now.select(*KEYS, "logdet").join(found.select(*KEYS, F.col("logdet").alias("before")), KEYS).filter("logdet < before - 1e-6").limit(1).count()
        discard(found)
        found = now
        if not moved:
            break
    near = _with_distance(vectors, found.drop("start", "logdet")).filter(F.col("d2") <= chi_square_quantile(REWEIGHT, len(X)))
    return _estimate(near.groupBy(*KEYS).agg(*_moments()), KEYS, consistency(REWEIGHT))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept).

    distance: the squared Mahalanobis distance within language and source, null where the base rules reject."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))], F.col(text_col).alias("text"))
    stats = written(with_vector(with_statistics(rows).drop("text")).withColumn("base_failed", base_failed()), "statistics")
    vectors = written(stats.filter("not base_failed").groupBy(*KEYS, *X).agg(F.count("*").alias("n")), "vectors")
    estimates = written(robust_estimates(vectors), "estimates")
    passed = _with_distance(stats.filter("not base_failed"), estimates).withColumnRenamed("d2", "distance")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    both = passed.select("id", *columns, "distance").unionByName(failed.select("id", *columns, "distance"))
    kept = F.coalesce(F.col("distance") <= chi_square_quantile(CUTOFF, len(X)), F.lit(False))
    return both.select(F.col("id").alias(id_col), *columns, "distance", kept.alias("kept"))
