"""Source divergence audit: how far the words of each source are from those of the other sources and of its language.

1. Documents of each term and language are counted exactly; terms of enough documents are kept.
2. The kept terms are dealt into shards by their hash. A task for each shard lays a minimal perfect hash
   over its terms (levels of bits; a term's slot is the rank of its bit) and writes it with the terms
   themselves to the shared folder: every task of the second pass opens these files, so that they are
   broadcast without going through the driver.
3. The second pass looks the distinct terms of a slice up, compares each with the term stored in the slot
   (other terms may meet a bit too), and adds to dense slots, an array for each group (language, source)
   and shard. Arrays leave the task sparsely when they are many, and are added up by group and shard, at
   first in SALTS shares, as one group may hold most rows.
4. A task for each shard and pair of blocks of sources compares the vectors of slots.

All arithmetic is on integers. No vocabulary, group or matrix is whole in one task: a shard has about
SHARD_TERMS terms, a block about BLOCK sources, a task's arrays have DENSE_SLOTS slots, and it keeps
CACHE_TERMS terms of shards read, so that larger vocabularies are read shard after shard for each slice.
The driver gets a row for each shard.

Rows: null text, language and source are ''; every row is a document, also where ids are null or repeat;
a document without terms still makes its group occur; languages without kept terms have pair rows with
value 0 and no term rows; groups that are alone in their language have no pair rows; tables without rows
give none. Other columns are not read."""

from __future__ import annotations

import pickle
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelplan.llm.common import shared_dir, written
from panelplan.llm.files import new_file, random_access
from panelplan.llm.memory import slices, tidy

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
SHARD_TERMS = 1 << 16
CACHE_TERMS = 4 << 20
DENSE_SLOTS = 8 << 20
HELD_TERMS = 400_000
BLOCK = 48
#: Beyond so many languages their numbers of shards are joined by a shuffle.
BROADCAST_LANGS = 10_000
SALTS = 16
SEED = 42
_LEVELS = 24
#: Terms are runs of ASCII letters and of all that is not ASCII; only A-Z are lowered.
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def term_hashes(terms: list[bytes]) -> np.ndarray:
    """XXH64 with Spark's seed, so that tasks and column expressions deal terms alike."""
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in terms), np.uint64, len(terms))


def _spread(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit of each hash in a level."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(bits)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct terms.

    A level has two bits for each term that the levels before left over; a bit is set where one term
    alone falls on it. What is left after all levels (equal hashes) is listed by name."""

    def __init__(self, terms: list[bytes]):
        hashes, rest = term_hashes(terms), np.arange(len(terms))
        slot_of = np.full(len(terms), -1, np.int64)
        self.begins, self.bits, words = [], [], []
        begin = taken = 0
        for level in range(_LEVELS):
            if not len(rest):
                break
            bits = -(-2 * len(rest) // 64) * 64
            at = _spread(hashes[rest], level, bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            lone = alone[at.astype(np.int64)]
            slot_of[rest[lone]] = taken + (np.cumsum(alone) - 1)[at[lone].astype(np.int64)]
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.begins.append(begin)
            self.bits.append(bits)
            begin += bits // 64
            taken += int(alone.sum())
            rest = rest[~lone]
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones  # ones before each word, over all levels
        slot_of[rest] = taken + np.arange(len(rest))
        self.named = {terms[k]: int(slot_of[k]) for k in rest.tolist()}
        self.terms = pa.array(terms, pa.binary()).take(pa.array(np.argsort(slot_of)))

    def __len__(self) -> int:
        return len(self.terms)

    def slots(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for terms that are not kept."""
        found, rest = np.full(len(terms), -1, np.int64), np.arange(len(terms))
        for level, (begin, bits) in enumerate(zip(self.begins, self.bits, strict=True)):
            at = _spread(hashes[rest], level, bits)
            word, bit = begin + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) > 0
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[rest[hit]] = self.rank[word[hit]] + np.bitwise_count(below)
            rest = rest[~hit]
        offered = np.flatnonzero(found >= 0)
        if len(offered):  # any term may fall on a set bit: the stored one decides
            same = pc.equal(self.terms.take(pa.array(found[offered])), pa.array(terms, pa.binary()).take(pa.array(offered)))
            found[offered[~same.to_numpy(zero_copy_only=False)]] = -1
        for k in rest.tolist() if self.named else ():
            found[k] = self.named.get(terms[k], -1)
        return found


def _documents_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many of a task's documents a term is, in parts."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, seen in held.items():
            names = pa.array(list(seen), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(seen)), names, pa.array(list(seen.values()), pa.int64())], ["lang", "term", "n"])
        held.clear()

    for part in (part for batch in batches for part in slices(batch)):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held[lang].update(set(terms_of(text)))
        if sum(map(len, held.values())) > HELD_TERMS:
            yield from out()
    yield from out()


def _plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n_docs) of the terms in at least min_docs documents of a language; docs: lang, text without nulls."""
    counted = docs.select("lang", "text").mapInArrow(tidy(_documents_of_terms), "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _shard(term: Column, shards: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(term), 32) % shards


def perfect_hash_files(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, shard, shards, n_terms, path): a file for each shard, written by the task that builds it."""
    folder = shared_dir(kept.sparkSession, "hashes")
    sizes = written(kept.groupBy("lang").agg(F.count("*").alias("v")).select("lang", F.ceil(F.col("v") / shard_terms).alias("shards")), "hash-sizes")
    if sizes.count() <= BROADCAST_LANGS:
        sizes = F.broadcast(sizes)

    def build(table: pa.Table) -> pa.Table:
        lang, shard, shards = (table.column(c)[0].as_py() for c in ("lang", "shard", "shards"))
        laid = PerfectHash(table.column("term").combine_chunks().cast(pa.binary()).to_pylist())
        with new_file(folder, f"shard-{shard}", ".pickle") as (path, out):
            out.write(pickle.dumps(laid))
        return pa.table({"lang": [lang], "shard": pa.array([shard], pa.int64()), "shards": pa.array([shards], pa.int64()), "n_terms": pa.array([len(laid)], pa.int64()), "path": [path]})

    dealt = kept.join(sizes, "lang").select("lang", _shard(F.col("term"), F.col("shards")).alias("shard"), "shards", "term")
    return written(dealt.repartition("lang", "shard").groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, shards long, n_terms long, path string"), "hash-files")


class _Shards:
    """Hashes read from files, those used last; a worker keeps about CACHE_TERMS terms."""

    held: OrderedDict[str, PerfectHash] = OrderedDict()

    @classmethod
    def get(cls, path: str) -> PerfectHash:
        if path in cls.held:
            cls.held.move_to_end(path)
            return cls.held[path]
        with random_access(path) as file:
            found = pickle.loads(file.read())
        while cls.held and sum(map(len, cls.held.values())) + len(found) > CACHE_TERMS:
            cls.held.popitem(last=False)
        cls.held[path] = found
        return found


_VECTOR = "lang string, source string, shard long, n long, slots binary, counts binary"


def _vector_row(lang: str, source: str | None, shard: int, dense: np.ndarray) -> tuple:
    """A vector of slots as its steps between the slots in use and their counts."""
    used = np.flatnonzero(dense)
    return lang, source, shard, int(dense.sum()), np.diff(used, prepend=0).astype("<i4").tobytes(), dense[used].astype("<i8").tobytes()


def _vector(slots: bytes | None, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(slots or b"", "<i4").astype(np.int64)), np.frombuffer(counts or b"", "<i8")


def _vector_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["lang", "source", "shard", "n", "slots", "counts"])


def _recounted(files: dict[str, dict[int, tuple[str, int]]], shards: dict[str, int]):
    """files: path and size by language and shard. Emits the slots of each group and shard."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: dict[tuple[str, str, int], np.ndarray] = {}
        room = DENSE_SLOTS

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source, shard), array in dense.items():
                yield _vector_batch([_vector_row(lang, source, shard, array)])
            dense.clear()

        for part in (part for batch in batches for part in slices(batch, rows=8192, size=8 << 20)):
            by_lang: dict[str, list[int]] = defaultdict(list)
            langs, sources, texts = part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text").cast(pa.binary())
            for k, lang in enumerate(langs):
                if lang in files:
                    by_lang[lang].append(k)
            for lang, rows in by_lang.items():
                number: dict[bytes, int] = defaultdict(count().__next__)
                of_source: dict[str, list[np.ndarray]] = defaultdict(list)
                for k in rows:
                    words = terms_of(texts[k].as_py())
                    of_source[sources[k]].append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                terms = list(number)
                hashes = term_hashes(terms)
                which = ((hashes >> np.uint64(32)) % np.uint64(shards[lang])).astype(np.int64)
                slot = np.full(len(terms), -1, np.int64)
                for shard in np.unique(which).tolist():
                    if shard in files[lang]:
                        mine = np.flatnonzero(which == shard)
                        slot[mine] = _Shards.get(files[lang][shard][0]).slots([terms[k] for k in mine.tolist()], hashes[mine])
                for source, words in of_source.items():
                    times = np.bincount(np.concatenate(words), minlength=len(terms))
                    seen = np.flatnonzero((times > 0) & (slot >= 0))
                    for shard in np.unique(which[seen]).tolist():
                        mine = seen[which[seen] == shard]
                        key, size = (lang, source, shard), files[lang][shard][1]
                        if key not in dense:
                            if room < size:
                                yield from out()
                                room = DENSE_SLOTS
                            dense[key] = np.zeros(size, np.int64)
                            room -= size
                        dense[key][slot[mine]] += times[mine]
        yield from out()

    return tidy(over)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the vectors of equal (lang, source, shard); rows come in this order."""
    key, dense = None, np.empty(0, np.int64)
    for batch in batches:
        for lang, source, shard, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "shard", "slots", "counts")), strict=True):
            if (lang, source, shard) != key:
                if key:
                    yield _vector_batch([_vector_row(*key, dense)])
                key, dense = (lang, source, shard), np.empty(0, np.int64)
            at, times = _vector(slots, counts)
            if len(at) and at[-1] >= len(dense):
                dense = np.concatenate((dense, np.zeros(int(at[-1]) + 1 - len(dense), np.int64)))
            dense[at] += times
    if key:
        yield _vector_batch([_vector_row(*key, dense)])


def _sum_of_vectors(rows: DataFrame, *salt: str) -> DataFrame:
    keys = ["lang", "source", "shard"]
    return rows.repartition(*keys, *salt).sortWithinPartitions(*keys, *salt).drop(*salt).mapInArrow(tidy(_added), _VECTOR)


def recount(docs: DataFrame, hash_files: DataFrame) -> DataFrame:
    """(lang, source, shard, n, slots, counts): occurrences of the kept terms in each group, by slot, n their sum."""
    files: dict[str, dict[int, tuple[str, int]]] = defaultdict(dict)
    shards = {}
    for r in hash_files.collect():  # a row for each shard
        files[r["lang"]][r["shard"]], shards[r["lang"]] = (r["path"], r["n_terms"]), r["shards"]
    found = docs.select("lang", "source", "text").mapInArrow(_recounted(dict(files), shards), _VECTOR)
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS)
    return written(_sum_of_vectors(_sum_of_vectors(salted, "salt")), "recount")


def shares(counts: np.ndarray, total: int, terms: int, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + terms)), exact also where 64 bits do not hold the product."""
    if not len(counts) or int(counts.max()) < (2**63 - 1) // scale - 1:
        return 1 + scale * (counts + 1) // (total + terms)
    return np.array([1 + scale * (c + 1) // (total + terms) for c in counts.tolist()], np.int64)


_PART = "lang string, source string, part string, item string, value long"


def _compared(top: int, scale: int):
    """Rows of one shard: blocks a and b of sources (role 1: a, 2: b, 3: both), and the language (source null)."""

    def over(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        size, terms = table.column("size")[0].as_py(), table.column("terms")[0].as_py()
        lang = table.column("lang")[0].as_py()
        rows = {"a": {}, "b": {}, "lang": None}
        for source, role, total, slots, counts in zip(*(table.column(c).to_pylist() for c in ("source", "role", "total", "slots", "counts")), strict=True):
            dense = np.zeros(size, np.int64)
            at, times = _vector(slots, counts)
            dense[at] = times
            p = shares(dense, total, terms, scale)
            if source is None:
                rows["lang"] = p
            else:
                if role & 1:
                    rows["a"][source] = (p, at)
                if role & 2:
                    rows["b"][source] = p
        for a, (p, used) in rows["a"].items():
            for b, q in rows["b"].items():
                if a != b:
                    out.append((lang, a, "pair", b, int(((p - q) ** 2 // q).sum())))
            if rows["lang"] is not None:
                path = table.column("path")[0].as_py()
                used = used[p[used] > rows["lang"][used]]
                p, q = p[used], rows["lang"][used]
                value = (p - q) ** 2 // q
                if len(value) > top:  # those that may be among the first of the group, ties included
                    least = np.partition(value, len(value) - top)[len(value) - top]
                    used, value = used[value >= least], value[value >= least]
                names = _Shards.get(path).terms.take(pa.array(used)).to_pylist()
                first = sorted(zip((-value).tolist(), names, strict=True))[:top]
                out += [(lang, a, "term", name.decode("utf-8", "replace"), -v) for v, name in first]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["lang", "source", "part", "item", "value"])

    return over


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP_TERMS, scale: int = SCALE, shard_terms: int = SHARD_TERMS, block: int = BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part pair: the divergence of a source from each other source of its language, over all kept terms.
    Part term: the `top` terms that a source has more of than its language."""
    docs = _plain(docs, text_col, lang_col, source_col)
    groups = written(docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs")), "groups")
    files = perfect_hash_files(written(kept_terms(docs, min_docs), "kept-terms"), shard_terms)
    vectors = recount(docs, files)
    of_lang = _sum_of_vectors(vectors.withColumn("source", F.lit(None).cast("string")).select("lang", "source", "shard", "n", "slots", "counts"))
    vocabulary = files.groupBy("lang").agg(F.sum("n_terms").alias("terms"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"))
    totals = vectors.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    lang_totals = totals.groupBy("lang").agg(F.sum("total").alias("total"))
    here = files.join(vocabulary, "lang").select("lang", "shard", F.col("n_terms").alias("size"), "terms", "path").join(blocks, "lang")

    sourced = (
        groups.select("lang", "source").join(here, "lang").join(totals, ["lang", "source"], "left")
        .join(vectors.select("lang", "source", "shard", "slots", "counts"), ["lang", "source", "shard"], "left")
        .withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")))
    )
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.array(F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(1).alias("role")), F.struct(k.alias("i"), F.col("own").alias("j"), F.lit(2).alias("role"))))
    own = F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j"), F.lit(3).alias("role")))
    elsewhere = F.filter(F.flatten(places), lambda x: x["i"] != x["j"])
    columns = ["lang", "source", "shard", "size", "terms", "path", F.coalesce("total", F.lit(0)).alias("total"), "slots", "counts"]
    of_sources = sourced.select(*columns, F.explode(F.concat(own, elsewhere)).alias("at"))
    of_langs = (
        here.join(lang_totals, "lang").join(of_lang.select("lang", "shard", "slots", "counts"), ["lang", "shard"], "left").withColumn("source", F.lit(None).cast("string"))
        .select(*columns, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(k.alias("i"), k.alias("j"), F.lit(0).alias("role")))).alias("at"))
    )
    both = of_sources.unionByName(of_langs).select("*", "at.i", "at.j", "at.role").drop("at")
    found = written(both.groupBy("lang", "shard", "i", "j").applyInArrow(_compared(top, scale), _PART), "compared")

    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = pairs.unionByName(found.filter("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(terms.select(*ranked.columns))
