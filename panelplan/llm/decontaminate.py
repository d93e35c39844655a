"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

The alphabet is words, a block is BLOCK_WORDS consecutive words. Patterns of one length m share a
shift table (block -> how far its last place in any pattern is from the end; other blocks skip
m - BLOCK_WORDS + 1 words) and buckets (last block -> patterns); what a bucket offers is compared
word by word. Windows have 13 words, so one table serves all but items shorter than that, which
have a table for each length.

Items are dealt into shards of at most SHARD_WINDOWS windows by Spark tasks, which write each shard to a
file in the shared folder. Documents are read once and nothing of them is written: where there are several
shards, a task takes HELD_BYTES of texts through one after the other. A worker thus holds one table of bounded
size at a time, however large the benchmark, and no item goes through the driver.

Rows: a null text has no words; an item without words has no window; items with a null id or text are
left out; equal windows of several items count for each; repeated item ids count once; repeated
documents and those with a null id are kept. Texts are searched whole, however long. Without documents
there are no rows, without items no hits. Columns of the same names as the result's are not carried over."""

from __future__ import annotations

import contextlib
import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelplan.llm.common import shared_dir
from panelplan.llm.files import new_file, random_access
from panelplan.llm.memory import slices, tidy

WINDOW = 13
BLOCK_WORDS = 3
SHARD_WINDOWS = 200_000
HELD_BYTES = 64 << 20
#: Bytes that separate words, after A-Z are lowered: all ASCII but 0-9 and a-z. As text, for SQL and tests.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TO_SPACE = bytes(c if chr(c).isdigit() or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_SPACE).split()


class WuManber:
    """Patterns of equal length over word lists."""

    def __init__(self, patterns: dict[tuple[bytes, ...], object], length: int):
        self.m, self.block, self.patterns = length, min(BLOCK_WORDS, length), patterns
        self.skip = self.m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[bytes, ...]]]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(self.block, self.m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.skip), self.m - end)
            self.buckets[p[-self.block :]][p[0]].append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        shift, m, block, skip, get = self.shift, self.m, self.block, self.skip, self.shift.get
        at, n = m, len(words)  # at: the end of the window looked at
        while at <= n:
            b = tuple(words[at - block : at])
            by = get(b, skip)
            if by:
                at += by
                continue
            start = at - m
            for p in self.buckets[b].get(words[start], ()) if b in self.buckets else ():
                if tuple(words[start:at]) == p:
                    yield start, p
            at += 1


class _Shard:
    """Searchers by pattern length over some items' words, built once in a worker; known by its file, whose name is its own."""

    built: dict[str, _Shard] = {}

    def __init__(self, items: list[tuple[str, int, list[bytes]]]):
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, k, words in items:
            for at in range(len(words) - k + 1):
                by_length[k][tuple(words[at : at + k])].append(item)
        self.searchers = [WuManber(p, m) for m, p in by_length.items()]

    @classmethod
    def of(cls, path: str | None) -> _Shard:
        if path not in cls.built:
            cls.built.clear()
            with random_access(path) if path else contextlib.nullcontext() as file:
                cls.built[path] = cls(pickle.loads(file.read()) if path else [])
        return cls.built[path]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, items = [], set()
        for s in self.searchers:
            for start, p in s.find(words):
                spans.append((start, start + s.m))
                items.update(s.patterns[p])
        return spans, items


def _pack(folder: str, window: int, limit: int):
    """Items into shard files; (path, n_windows) of each. The windows of a long item may go to several."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, []

        def write() -> None:
            with new_file(folder, "shard", ".pickle") as (path, out):
                out.write(pickle.dumps(held))
            done.append((path, size))

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = words_of(text.as_py())
                k = min(window, len(words))
                for at in range(0, len(words) - k + 1 if words else 0, limit):
                    part = words[at : at + limit + k - 1]
                    if held and size + len(part) - k + 1 > limit:
                        write()
                        held, size = [], 0
                    held.append((item, k, part))
                    size += len(part) - k + 1
        if held:
            write()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_windows"])

    return tidy(over)


def _covered(starts: list[int], ends: list[int]) -> int:
    total, reach = 0, 0
    for s, e in sorted(zip(starts, ends, strict=True)):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, in groups of about `size` bytes of text."""
    held, total = [], 0
    for part in (part for whole in batches for part in slices(whole)):
        held.append(part)
        total += part.column("text").nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _scan(paths: list[str | None], keep_text: bool, size: int):
    """Search all shards. A task takes the texts of a group through one shard after the other; the next group
    begins with the shard that is held."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = list(paths)
        for parts in _held(batches, size if len(paths) > 1 else 1):
            texts = [[t.as_py() for t in part.column("text").cast(pa.binary())] for part in parts]
            spans: list[list[list[tuple[int, int]]]] = [[[] for _ in t] for t in texts]
            items: list[list[set[str]]] = [[set() for _ in t] for t in texts]
            n_words = [[0] * len(t) for t in texts]
            for path in order:
                shard = _Shard.of(path)
                for p, part in enumerate(texts):
                    for k, text in enumerate(part):
                        words = words_of(text)
                        found, names = shard.search(words)
                        n_words[p][k] = len(words)
                        spans[p][k] += found
                        items[p][k] |= names
            order.reverse()
            for p, part in enumerate(parts):
                named = [sorted(x) for x in items[p]]
                columns = {
                    "id": part.column("id"),
                    "n_words": pa.array(n_words[p], pa.int64()),
                    "n_hit": pa.array([_covered([s for s, _ in x], [e for _, e in x]) for x in spans[p]], pa.int64()),
                    "items": pa.array(named, pa.list_(pa.string())),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
                }
                if keep_text:
                    columns["text"] = part.column("text")
                yield pa.RecordBatch.from_pydict(columns)

    return tidy(over)


def shard_files(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, limit: int = SHARD_WINDOWS) -> list[str]:
    """The files of a benchmark's shards, written by Spark tasks; the driver gets their names only."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (8 * limit)))  # a word and what separates it take 8 bytes or less in most texts; tasks cut at the limit anyway
    files = rows.repartition(parts).mapInArrow(_pack(shared_dir(benchmark.sparkSession, "shards"), window, limit), "path string, n_windows long")
    return sorted(r["path"] for r in files.collect())  # a row per shard


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_windows: int = SHARD_WINDOWS, keep_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items, items_sha256, contaminated), and text with keep_text, for each document.

    n_hit: words inside any occurrence of a window; items: sorted ids whose windows occur;
    contaminated: n_hit > 0 and 20 * n_hit >= n_words."""
    paths = shard_files(benchmark, item_col, item_text_col, window, shard_windows) or [None]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_scan(paths, keep_text, HELD_BYTES), f"id {kind}, n_words long, n_hit long, items array<string>, items_sha256 string{', text string' * keep_text}")
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "items_sha256",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), *["text"] * keep_text,
    )
