"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Vectors are dealt to the nearest of k centroids and rotated by a fixed random orthogonal matrix; rotated
vectors are kept in column blocks of BLOCK_DIMS dimensions. There are about sqrt(N) / 4 lists, LISTS at
most; their centroids come from k-means rounds that Spark runs over a sample of about SAMPLE_PER_LIST
vectors a list. A query probes the lists of its nearest centroids: as many as hold the share TARGET of
the true neighbours of TRIAL_QUERIES vectors within TRIAL_ROWS sample vectors, whose neighbours lie
farther off than those among all rows, and as many as hold enough vectors.

Within a list, the squared distance of all its candidates is accumulated block by block; after each
block a hypothesis test compares the partial distance, scaled to all dimensions, with the query's k-th
best so far: a candidate whose scaled part exceeds it by more than the margin EPSILON / sqrt(dimensions
seen) is abandoned. The survivors get their exact distance on the original vectors, in double precision,
summed dimension by dimension. A query scans its nearest list first; the k-th best from there is the bar
that it carries to its other lists.

Of equal vectors only the k + 1 with the smallest ids are candidates: any other copy has k others that
are as near and come before it. Queries with equal vectors are one search, from whose k + 1 nearest each
query drops itself. Lists are cut into blocks of about LIST_BLOCK vectors by a hash of the id, and the
queries of a list into blocks of QUERY_BLOCK, so that a list with a third of all vectors, or one probed
by all queries, is spread over many tasks. Centroids, rotation and list sizes are broadcast: their size
is bounded by LISTS.

Rows: vectors that are null, zero, of another length than most of the sample's, or hold null or
non-finite components take no part, as queries or candidates; so do rows with a null id. Of rows
with one id, the smallest vector (as an array) counts. Ties go to the smaller id. Tables without a usable
vector give no rows; other columns are left out."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelplan.llm.common import top_k, written
from panelplan.llm.memory import tidy

LISTS = 16_384
SAMPLE_PER_LIST = 64
ROUNDS = 4
TRIAL_ROWS = 20_000
TRIAL_QUERIES = 200
TARGET = 0.975
BLOCK_DIMS = 16
EPSILON = 2.1
LIST_BLOCK = 4096
QUERY_BLOCK = 1024
#: Queries whose lists are put into order at a time: PROBE_ROWS * LISTS numbers at most.
PROBE_ROWS = 256


def usable(vector: Column) -> Column:
    """Whether a vector has no null or non-finite component and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each vector, nearest first."""
    out = []
    for at in range(0, len(vectors), 1024):
        d = (centres**2).sum(axis=1) - 2 * vectors[at : at + 1024] @ centres.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def exact_distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances, in double precision, summed from the first dimension to the last."""
    if not vectors.size:
        return np.zeros(len(vectors))
    return np.sqrt(np.add.accumulate((vectors - query) ** 2, axis=1)[:, -1])


def column_blocks(turned: np.ndarray) -> list[np.ndarray]:
    """Rotated vectors as one array for each BLOCK_DIMS dimensions."""
    return [np.ascontiguousarray(turned[:, at : at + BLOCK_DIMS], np.float32) for at in range(0, turned.shape[1], BLOCK_DIMS)]


def scan(query: np.ndarray, turned: list[np.ndarray], ids: np.ndarray, vectors: np.ndarray, blocks: list[np.ndarray], k: int, known: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of a list's block by the adaptive scan, as far as they are not beyond `known`.

    turned, blocks: the query and the vectors, rotated, by column block."""
    first = np.arange(0 if np.isfinite(known) else min(256, len(ids)))  # without a bar, these set it
    found = exact_distances(query, vectors[first])
    bar = min(known, np.partition(found, k - 1)[k - 1] if len(found) >= k else np.inf) ** 2
    rest, dims = np.arange(len(first), len(ids)), len(query)
    part, seen = np.zeros(len(rest)), 0
    for block, own in zip(blocks, turned, strict=True):
        if not len(rest):
            break
        apart = (block[rest] if len(rest) < len(block) else block) - own
        part += np.einsum("ij,ij->i", apart, apart)
        seen += len(own)
        margin = 1.0 if seen == dims else (1 + EPSILON / np.sqrt(seen)) ** 2
        keep = part * (dims / seen) <= bar * margin * (1 + 1e-4) + 1e-12  # blocks are in single precision
        rest, part = rest[keep], part[keep]
    all_ = np.concatenate((first, rest))
    score = np.concatenate((found, exact_distances(query, vectors[rest])))
    best = np.lexsort((ids[all_], score))[:k]
    return ids[all_[best]], score[best]


def _array(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(matrix).reshape(-1), kind))


def _sums(held, dims: int):
    """Sum and number of a partition's vectors by nearest centroid."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
        for batch in batches:
            v = _array(batch.column("v"), dims)
            owner = nearest(v, centres, 1)[:, 0] if len(v) else np.empty(0, np.int64)
            n += np.bincount(owner, minlength=len(centres))
            np.add.at(total, owner, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), _lists(total[some], pa.float64())], ["list", "n", "total"])

    return tidy(over)


def _added(dims: int):
    """Sums of a list, from all partitions, in one row; the rows of a list come in turn."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, count, v in zip(batch.column("list").to_pylist(), batch.column("n").to_pylist(), _array(batch.column("total"), dims), strict=True):
                n[key] += count
                total[key] = total[key] + v if key in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n[key] for key in total], pa.int64()), _lists(np.stack(list(total.values())), pa.float64())], ["list", "n", "total"])

    return over


def fit_centres(sample: DataFrame, lists: int, dims: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means over (id, v): it begins with the `lists` vectors of the smallest hash; each round is a Spark job
    that returns a row for each list."""
    spark = sample.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    begin = sample.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(lists).select("v").collect()  # LISTS vectors at most
    centres = np.unique(np.array([r["v"] for r in begin], np.float64), axis=0)
    shape = "list int, n long, total array<double>"
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(centres)
        for r in sample.select("v").mapInArrow(_sums(held, dims), shape).repartition(min(n, len(centres)), "list").mapInArrow(_added(dims), shape).collect():
            centres[r["list"]] = np.array(r["total"]) / r["n"]
        held.unpersist()
    return centres


def probes_needed(data: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET, seed: int = 3) -> int:
    """How many lists hold the share `target` of the k nearest of sample vectors within the sample."""
    asked = np.random.default_rng(seed).choice(len(data), min(TRIAL_QUERIES, len(data)), replace=False)
    owner, order = nearest(data, centres, 1)[:, 0], nearest(data[asked], centres, len(centres))
    place = np.argsort(order, axis=1)
    needed = []
    for q, row in zip(asked.tolist(), place, strict=True):
        d = ((data - data[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        n = min(k, len(data) - 1)
        needed += row[owner[np.argpartition(d, n - 1)[:n]]].tolist() if n else [0]
    return int(np.quantile(needed, target, method="higher")) + 1


def _assign(held, dims: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn = held.value
        for batch in batches:
            v = _array(batch.column("v"), dims)
            owner = nearest(v, centres, 1)[:, 0] if len(v) else np.empty(0)
            blocks = column_blocks(v @ turn)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), batch.column("id"), batch.column("v"), *[_lists(b, pa.float32()) for b in blocks]], ["list", "id", "v", *[f"b{k}" for k in range(len(blocks))]])

    return tidy(over)


def _probe(held, dims: int, probes: int, enough: int):
    """The lists that each query probes, nearest first (turn 0): `probes` of them, and more until they hold `enough` vectors."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes = held.value
        for batch in (whole.slice(at, PROBE_ROWS) for whole in batches for at in range(0, whole.num_rows, PROBE_ROWS)):
            v = _array(batch.column("v"), dims)
            order = nearest(v, centres, len(centres)) if len(v) else np.empty((0, len(centres)), np.int64)
            short = np.cumsum(sizes[order], axis=1) - sizes[order] < enough
            wanted = short | (np.arange(len(centres)) < probes)
            row, turn = np.nonzero(wanted & (sizes[order] > 0))
            yield pa.RecordBatch.from_arrays([pa.array(order[row, turn], pa.int32()), pa.array(turn, pa.int32()), batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row))], ["list", "turn", "id", "v"])

    return tidy(over)


_FOUND = "query_id long, vec_id long, score double"


def _search(held, dims: int, k: int):
    def of(key, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if candidates.num_rows and queries.num_rows:
            turn = held.value[1]
            ids = candidates.column("id").to_numpy()
            vectors = _array(candidates.column("v").combine_chunks(), dims)
            widths = [min(BLOCK_DIMS, dims - at) for at in range(0, dims, BLOCK_DIMS)]
            blocks = [candidates.column(f"b{j}").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, w) for j, w in enumerate(widths)]
            wanted = _array(queries.column("v").combine_chunks(), dims)
            turned = column_blocks(wanted @ turn)
            for j, (q, bar) in enumerate(zip(queries.column("id").to_pylist(), queries.column("bar").to_pylist(), strict=True)):
                found, score = scan(wanted[j], [t[j] for t in turned], ids, vectors, blocks, k, np.inf if bar is None else bar)
                out_q.append(np.full(len(found), q))
                out_v.append(found)
                out_s.append(score)
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"query_id": join(out_q, pa.int64()), "vec_id": join(out_v, pa.int64()), "score": join(out_s, pa.float64())})

    return of


def _scanned(listed: DataFrame, queries: DataFrame, held, dims: int, k: int, list_block: int, query_block: int) -> DataFrame:
    """(query_id, vec_id, score): each query (list, id, v, bar) with the blocks of its list."""
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / list_block).cast("int").alias("parts"))  # LISTS rows at most
    asked = queries.groupBy("list").agg(F.ceil(F.count("*") / query_block).cast("int").alias("asked"))
    shape = F.broadcast(sizes.join(asked, "list"))
    cut = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = [c for c in listed.columns if c not in ("list", "id", "v")]
    candidates = listed.join(shape, "list").select("list", cut("parts").alias("part"), each("asked").alias("block"), "id", "v", *blocks)
    wanted = queries.join(shape, "list").select("list", each("parts").alias("part"), cut("asked").alias("block"), "id", "v", "bar")
    keys = ["list", "part", "block"]
    return candidates.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(_search(held, dims, k), _FOUND)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, lists: int | None = None, list_block: int = LIST_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets is_query (a condition on `id`), its k
    nearest among all other rows found, nearest first; score is the Euclidean distance."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = written(clean.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    hashed = F.xxhash64("id", F.lit(3))
    trial = rows.orderBy(hashed, "id").limit(TRIAL_ROWS).select("v").collect()  # TRIAL_ROWS vectors
    if not trial:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = max(Counter(len(r["v"]) for r in trial).items(), key=lambda x: (x[1], -x[0]))[0]
    rows = rows.filter(F.size("v") == dims)
    candidates = top_k(rows, ["v"], [F.col("id")], k + 1, "copy").drop("copy")
    total = rows.count()
    lists = lists or int(np.clip(np.sqrt(total) / 4, 1, LISTS))
    share = min(1.0, lists * SAMPLE_PER_LIST / total)
    sample = written(rows.filter(F.pmod(hashed, F.lit(1_000_000)) < max(1, int(1_000_000 * share))), "sample")
    centres = fit_centres(sample if share < 1 else rows, lists, dims)
    data = np.unique(np.array([r["v"] for r in trial if len(r["v"]) == dims], np.float64), axis=0)
    needed = probes or probes_needed(data, centres, k)
    held = spark.sparkContext.broadcast((centres, rotation(dims)))
    blocks = "".join(f", b{j} array<float>" for j in range(-(-dims // BLOCK_DIMS)))
    listed = written(candidates.mapInArrow(_assign(held, dims), f"list int, id long, v array<double>{blocks}"), "lists")
    sizes = np.zeros(len(centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # a row per list
        sizes[r["list"]] = r["count"]
    queries = rows.filter(is_query)
    searches = written(queries.groupBy("v").agg(F.min("id").alias("id")), "searches")
    sized = spark.sparkContext.broadcast((centres, sizes))
    probed = written(searches.mapInArrow(_probe(sized, dims, needed, k + 1), "list int, turn int, id long, v array<double>"), "probes")
    scanned = lambda q: _scanned(listed, q, held, dims, k + 1, list_block, query_block)
    near = written(scanned(probed.filter("turn = 0").withColumn("bar", F.lit(None).cast("double"))), "near")
    bars = top_k(near, ["query_id"], [F.col("score"), F.col("vec_id")], k + 1).filter(F.col("rank") == k + 1).select(F.col("query_id").alias("id"), F.col("score").alias("bar"))
    far = scanned(probed.filter("turn > 0").join(bars, "id", "left"))
    best = top_k(near.unionByName(far), ["query_id"], [F.col("score"), F.col("vec_id")], k + 1)
    found = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # k + 1 each
    same = queries.join(searches.withColumnRenamed("id", "search"), "v").select("id", "search")
    answers = same.join(found, F.col("search") == F.col("query_id")).select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
