"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 4 bits differ in at most 4
bytes, so at least 4 positional bytes are shared. The inverted index lists fingerprints under
keys of three positional bytes; the 20 position triples below are a Turan system: every set of 4
positions holds one of them, so each pair with 4 shared bytes meets in some list. Within a list
the shared positional bytes of a pair are tallied, pairs below 4 are dropped, and the rest are
verified by their differing bits. Three-byte keys rather than single bytes keep the lists short
(N / 2^24 rather than N / 2^8 for unrelated texts).

Equal fingerprints are collapsed before anything is compared. Lists longer than BLOCK are dealt
into blocks, and each pair of blocks is a list of its own: no task holds more than about two
blocks, and each emits a spanning forest of its links, never all pairs.

Rows: null texts and texts without words have fingerprint 0 and are linked like any other; rows
with a null id have no part in links and are their own component (null where no other row has
their fingerprint); repeated rows are kept. Very long texts are hashed whole, in runs of shingles;
tables without rows give none. Columns of the same names as the result's are not carried over."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelplan.llm.common import min_component, written
from panelplan.llm.memory import slices, tidy

BLOCK = 16384
BITS = 4
_CHUNK = 1 << 16


def simhash(text: bytes | None, words: int = 4) -> int:
    """The 64-bit fingerprint of UTF-8 text, A-Z lowered: bit set if in over half the shingles' XXH64 (seed 42)."""
    found = (text or b"").lower().split()  # bytes: only A-Z change; separators are x20 and x09-x0D
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashed = b"".join([digest(whole[s:e], 42) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big", signed=True)


def _fingerprints(words: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, rows=10_000)):
            texts = batch.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash(t.as_py(), words) for t in texts], pa.int64())], ["id", "fp"])

    return tidy(over)


def position_triples() -> list[tuple[int, ...]]:
    """Three byte positions each, such that any 4 of the 8 positions hold one of them (Turan's construction)."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]

    def kept(triple: tuple[int, ...]) -> bool:
        sizes = [sum(part[x] == g for x in triple) for g in range(3)]
        return max(sizes) == 3 or any(sizes[g] == 2 and sizes[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(8), 3) if kept(t)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def postings(nodes: DataFrame) -> DataFrame:
    """(slot, key, fp, rep): each fingerprint under each of its position triples."""
    keys = [F.struct(F.lit(slot).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(sum(0xFF << (8 * p) for p in triple))).cast("long")).alias("key")) for slot, triple in enumerate(position_triples())]
    return nodes.select(F.explode(F.array(*keys)).alias("k"), "fp", "rep").select("k.slot", "k.key", "fp", "rep")


def _blocked(lists: DataFrame, block: int) -> DataFrame:
    """Add (one, two): the pair of blocks; rows of lists longer than `block` go to each pair that holds their block."""
    hot = lists.groupBy("slot", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    marked = lists.join(hot.drop("n"), ["slot", "key"], "left")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("blocks", F.lit(1))).cast("int")
    return (
        marked.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select("slot", "key", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "fp", "rep")
    )


_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def linked(differ: np.ndarray, bits: int) -> np.ndarray:
    """Which XORs of two fingerprints pass: 8 less the tally of shared positional bytes is `bits` at most, then verified by bits."""
    other_bytes = np.bitwise_count((((differ & _LOW) + _LOW) | differ) & _HIGH)
    keep = other_bytes <= bits
    keep[keep] = np.bitwise_count(differ[keep]) <= bits
    return keep


def _forest(fp: np.ndarray, rep: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is linked within one list: each row is compared with those not reached yet."""
    edges, left, queue = [], np.arange(len(fp)), []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        near = linked(fp[left] ^ fp[at], bits)
        if near.any():
            found = left[near]
            edges.append((np.full(len(found), rep[at]), rep[found]))
            queue.extend(found.tolist())
            left = left[~near]
    return edges


def _links(bits: int, small: int = 6):
    def of(rows: pa.Table) -> pa.RecordBatch:
        key = [rows.column(c).to_numpy() for c in ("slot", "key", "one", "two")]
        fp, rep = rows.column("fp").to_numpy().astype(np.int64).view(np.uint64), rows.column("rep").to_numpy()
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(starts)), sizes)
        edges = []
        for d in range(1, small):  # short lists: all their pairs at once
            i = np.flatnonzero((group[d:] == group[:-d]) & (sizes[group[d:]] <= small)) if len(fp) > d else np.empty(0, int)
            i = i[linked(fp[i + d] ^ fp[i], bits)]
            edges.append((rep[i], rep[i + d]))
        for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
            edges += _forest(fp[s : s + n], rep[s : s + n], bits)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[x] for e in edges]), pa.int64()) for x in (0, 1)], ["a", "b"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last list may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held)
            key = [whole.column(c).to_numpy() for c in ("slot", "key", "one", "two")]
            other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield of(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield of(pa.Table.from_batches(held))

    return over


def fingerprint_links(nodes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between `rep` of distinct fingerprints (fp, rep) at `bits` or fewer differing bits,
    enough of them to join all that are linked. bits: 4 at most, by the index's guarantee."""
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees pairs of up to 4 differing bits")
    lists = _blocked(postings(nodes), block)
    order = ["slot", "key", "one", "two"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(_links(bits), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(id_col, fingerprint, component_id): a row per document with its fingerprint in hex and the
    smallest id among all that it is linked to, directly or through others."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = written(named.mapInArrow(_fingerprints(words), "id long, fp long"), "simhash")
    nodes = marks.groupBy("fp").agg(F.min("id").alias("rep"))
    parts = min_component(fingerprint_links(nodes.filter("rep is not null"), bits, block))
    found = nodes.join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marks.join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _first_rows(rows: DataFrame, words: int = 4, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The smallest `row` (__id, __th) of each group of linked fingerprints; nodes are fingerprints, as ids may repeat."""
    marks = rows.mapInArrow(_fingerprints(words), "id struct<__id: bigint, __th: bigint>, fp long")
    nodes = written(marks.groupBy("fp").agg(F.min("id").alias("first")), "simhash")
    parts = min_component(fingerprint_links(nodes.select("fp", F.col("fp").alias("rep")), bits, block))
    groups = nodes.join(parts, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("component", "fp").alias("group"))
    return groups.agg(F.min("first").alias("first")).select("first.*")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of linked fingerprints: that with the smallest id, of equal ids the smallest text hash.

    Rows decide, not ids: rows that share an id but no link stay both, and of a row and its repetition
    one stays. Rows with a null id have no part in links and all stay."""
    columns = docs.columns
    keyed = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    keep = _first_rows(keyed.filter("__id is not null").select(F.struct("__id", "__th").alias("row"), F.col(text_col).alias("text")), **how)
    order = F.to_json(F.struct(*[c for c in columns if c != text_col]))
    found = keyed.join(keep, ["__id", "__th"], "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__th").orderBy(order))).filter("__n = 1")
    return found.select(columns).unionByName(docs.filter(F.col(id_col).isNull()))
