"""Token ids in Arrow files: equal-length sequences and their masks, for random access without copying.

Each file is an Arrow IPC file whose batches have two fixed-size-list columns: `ids` (the smallest
unsigned type that the vocabulary fits) and `mask` (true for a token, false for padding at a file's end).
Sequence k of a file is row k; mapped to memory, its values are a view. Beside it lies an index file
with a row for each document: its id, where its ids begin in the file, and how many there are.

Documents are dealt by ranges of their ids, one range to a file, so files in turn hold documents in
ascending order; within a range Spark sorts them. An id that fills several ranges on its own (or the
null id) is dealt to as many files by a hash of the text. A manifest has one row per file.

Rows: null texts are empty (just the end id); null document ids come first; repeated ids are kept,
in the order of their texts' hash; a very long text is a row of one file, written in batches; tables without
rows have no files and give no rows. Other columns of docs are left out, so their names do not matter."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelplan.llm.bpe import byte_letters
from panelplan.llm.common import shared_dir, written
from panelplan.llm.files import new_file, random_access
from panelplan.llm.memory import Lists, slices, tidy

SEQUENCE = 2048
BATCH_SEQUENCES = 128
KEPT_CHUNKS = 1_000_000
#: Fixed value: the split pattern of vocabularies with word ends; below, the same for lower-case Latin-1
#: without the characters that Python's classes sort otherwise (x1C-x1F, superscripts, fractions).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_PIECES = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s0-9{_LETTERS}]+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-;=-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")  # nor <, which begins special tokens
_ENCODERS: dict[str, ChunkEncoder] = {}
_NULL_ID = -(1 << 63)
MANIFEST = "part int, path string, index_path string, n_docs long, n_ids long"


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct blank-separated chunk once.

    Right for tokenizers that drop blanks, split at them and treat what lies between alike wherever
    it stands; checked on the vocabulary's file: normalizers NFC, Replace, Lowercase; a Split that
    keeps no white space. Where the split is SPLIT after lowering, chunks of Latin-1 letters are cut
    at it first, so that "word", "Word" and "word," share a piece."""

    def __init__(self, text: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task one core
        from tokenizers import Tokenizer

        spec = json.loads(text)
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        normal = spec.get("normalizer") or {"normalizers": []}
        whole = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s" in parts[0]["pattern"].get("Regex", "")
        self.by_chunk = bool(whole) and {n["type"] for n in normal.get("normalizers", [normal])} <= {"NFC", "Replace", "Lowercase"}
        self.by_piece = self.by_chunk and parts[0]["pattern"]["Regex"] == SPLIT and "Lowercase" in {n["type"] for n in normal.get("normalizers", [normal])}
        self.tokenizer = Tokenizer.from_str(text)
        self._prepare_bare(spec, parts)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = np.array([] if end_id is None else [end_id], np.int64)
        self._forget()

    def _prepare_bare(self, spec: dict, parts: list[dict]) -> None:
        """The same BPE model of the library without the steps before it, for pieces that need none: the
        words of a line, cut at blanks; where a word's last token has the word-end mark, words part there."""
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = spec["model"].get("end_of_word_suffix")
        bytewise = len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
        self.bare = None
        if self.by_piece and suffix and bytewise:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            letter_of = {b: c for c, b in byte_letters().items()}
            self.letters = {c: "".join(letter_of[b] for b in chr(c).encode()) for c in range(256)}
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)

    def _encode_plain(self, pieces: list[str], line: int = 256) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many each has) of Latin-1 pieces in lower case, many to a line; None if words and word ends do not agree."""
        written = [p.translate(self.letters) for p in pieces]
        found = self.bare.encode_batch_fast([" ".join(written[at : at + line]) for at in range(0, len(written), line)], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.int64) for e in found])
        cuts = np.flatnonzero(self.ends[flat]) + 1
        if len(cuts) != len(pieces) or cuts[-1] != len(flat):
            return None
        return flat, np.diff(cuts, prepend=0)

    def _encode_pieces(self, pieces: list[str]) -> None:
        whole = lambda p: [e.ids for e in self.tokenizer.encode_batch_fast(p, add_special_tokens=False)]
        plain = np.array([bool(p) and self.bare is not None and not _NOT_PLAIN.search(p) for p in pieces], bool)
        found = self._encode_plain([p for p, ok in zip(pieces, plain, strict=True) if ok]) if plain.any() else None
        if found is None:
            self.piece_ids.append(*_flat(whole(pieces)))
            return
        both = Lists()
        both.append(*found)
        both.append(*_flat(whole([p for p, ok in zip(pieces, plain, strict=True) if not ok])))
        order = np.empty(len(pieces), np.int64)
        order[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = np.arange(len(pieces))
        self.piece_ids.append(both.take(order), both.size[order])

    def _forget(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)  # of chunks
        self.pieces: dict[str, int] = defaultdict(count().__next__)
        self.chunk_ids, self.piece_ids = Lists(), Lists()

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks by way of the pieces that are new among theirs."""
        cut = lambda c: _PIECES.findall(c.lower()) if self.by_piece and not _NOT_PLAIN.search(c) else [c]
        rows = [cut(c) for c in chunks]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        piece = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        new = list(self.pieces)[len(self.piece_ids) :]
        for at in range(0, len(new), 20_000):
            self._encode_pieces(new[at : at + 20_000])
        owner = np.repeat(np.arange(len(rows)), sizes)
        n_ids = np.bincount(owner, weights=self.piece_ids.size[piece], minlength=len(rows)).astype(np.int64)
        self.chunk_ids.append(self.piece_ids.take(piece), n_ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.concatenate((np.array(e.ids, np.int64), self.end)) for t in texts for e in self.tokenizer.encode_batch_fast([t or ""], add_special_tokens=False)]
        if len(self.place) > KEPT_CHUNKS:
            self._forget()
        place = self.place.__getitem__
        chunks = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]  # "" is a chunk without ids
        rows = [np.fromiter(map(place, c), np.int64, len(c)) for c in chunks]
        if len(self.place) > len(self.chunk_ids):
            self._learn(list(self.place)[len(self.chunk_ids) :])
        return [np.concatenate((self.chunk_ids.take(row), self.end)) for row in rows]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _dtype(vocab_size: int) -> str:
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def part_of(ids: np.ndarray, h: np.ndarray, bounds: list[int]) -> np.ndarray:
    """The range of each id among bounds in order; one that is a bound several times has its rows dealt to as
    many ranges, in the order of their hash (unsigned)."""
    edges = np.array(bounds, np.int64)
    first, after = np.searchsorted(edges, ids, side="left"), np.searchsorted(edges, ids, side="right")
    times = np.maximum(after - first, 1)
    return first + np.minimum((h >> np.uint64(11)) * 2.0**-53 * times, times - 1).astype(np.int64)


def _tokenize(held, dtype: str, end_id: int | None, bounds: list[int]):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{hashlib.sha256(held.value.encode()).hexdigest()}-{end_id}"
        if key not in _ENCODERS:
            _ENCODERS[key] = ChunkEncoder(held.value, end_id)
        for part in (part for batch in batches for part in slices(batch, size=4 << 20)):
            ids = part.column(0)
            texts = part.column(1).cast(pa.binary())
            h = np.array([xxhash.xxh3_64_intdigest(t.as_py() or b"") for t in texts], np.uint64)
            where = part_of(ids.fill_null(_NULL_ID).to_numpy(), h, bounds)
            rows = [x.astype(dtype).tobytes() for x in _ENCODERS[key].encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), ids, pa.array(h.view(np.int64) ^ _NULL_ID), pa.array(rows, pa.binary())], ["part", "id", "h", "ids"])

    return tidy(over)


class _Writer:
    """One file of sequences and its index."""

    def __init__(self, folder: str, part: int, dtype: str, length: int):
        self.dtype, self.length, self.part = np.dtype(dtype), length, part
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        self.held = [new_file(folder, f"tokens-{part:06d}", ".arrow"), new_file(folder, f"index-{part:06d}", ".arrow")]
        (self.path, a), (self.index_path, b) = (h.__enter__() for h in self.held)
        self.out, self.index = pa.ipc.new_file(a, self.schema), pa.ipc.new_file(b, self.index_schema)
        self.waiting, self.n_waiting, self.n_ids, self.n_docs = [], 0, 0, 0
        self.rows: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_ids, len(ids)))
        self.n_docs += 1
        self.n_ids += len(ids)
        self.n_waiting += len(ids)
        self.waiting.append(ids)
        if self.n_waiting >= self.length * BATCH_SEQUENCES:
            self._flush(False)
        if len(self.rows) >= 50_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.dtype)
        unit = self.length * BATCH_SEQUENCES
        end = len(flat) if last else len(flat) // unit * unit
        for at in range(0, end, unit):
            ids = flat[at : min(at + unit, end)]
            n = -(-len(ids) // self.length) * self.length
            mask = np.zeros(n, bool)
            mask[: len(ids)] = True
            padded = np.concatenate((ids, np.zeros(n - len(ids), self.dtype)))
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.waiting, self.n_waiting = [flat[end:]], len(flat) - end

    def _flush_index(self) -> None:
        if self.rows:
            self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=self.index_schema))
        self.rows = []

    def close(self) -> dict:
        self._flush(True)
        self._flush_index()
        self.out.close()
        self.index.close()
        for h in self.held:
            h.__exit__(None, None, None)
        return {"part": self.part, "path": self.path, "index_path": self.index_path, "n_docs": self.n_docs, "n_ids": self.n_ids}


def _write(folder: str, dtype: str, length: int):
    names = [c.split(" ")[0] for c in MANIFEST.split(", ")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for part, doc_id, ids in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), batch.column("ids"), strict=True):
                if writer is None or writer.part != part:
                    if writer:
                        done.append(writer.close())
                    writer = _Writer(folder, part, dtype, length)
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), dtype))
        if writer:
            done.append(writer.close())
        rows = [[d[n] for d in done] for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)

    return over


def write_token_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, length: int = SEQUENCE, files: int | None = None) -> DataFrame:
    """Encode docs with the tokenizer file `path`, append end_id to each, and write Arrow files to `folder`.

    Returns the manifest (part, path, index_path, n_docs, n_ids), itself written to the folder, as
    rows of the tasks that ended well. files: about how many; the shuffle partitions if not given."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:  # a vocabulary file on the driver, a few MB whatever the data
        text = f.read()
    spec = json.loads(text)
    dtype = _dtype(1 + max([end_id or 0, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]))
    held = spark.sparkContext.broadcast(text)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    steps = [k / files for k in range(1, files)]
    bounds = sorted(rows.agg(F.percentile_approx(F.coalesce("id", F.lit(_NULL_ID)), F.lit(steps), F.lit(max(10_000, 100 * files)))).first()[0] or []) if steps else []
    tokens = rows.mapInArrow(_tokenize(held, dtype, end_id, bounds), "part int, id long, h long, ids binary")
    dealt = tokens.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "h", "ids")
    return written(dealt.mapInArrow(_write(folder, dtype, length), MANIFEST), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files in batches:
        for path, index_path, base in zip(files.column("path").to_pylist(), files.column("index_path").to_pylist(), files.column("base").to_pylist(), strict=True):
            reader, index = pa.ipc.open_file(random_access(path)), pa.ipc.open_file(random_access(index_path))
            per_batch, at, held = None, -1, None
            for k in range(index.num_record_batches):
                rows = index.get_batch(k)
                crcs = []
                for offset, n in zip(rows.column("offset").to_pylist(), rows.column("n_tokens").to_pylist(), strict=True):
                    crc = 0
                    while n:
                        if per_batch is None:
                            per_batch = reader.get_batch(0).num_rows * reader.schema.field("ids").type.list_size
                        if offset // per_batch != at:
                            at = offset // per_batch
                            held = reader.get_batch(at).column("ids").flatten().to_numpy()
                        take = min(n, per_batch - offset % per_batch)
                        crc = zlib.crc32(held[offset % per_batch : offset % per_batch + take].astype("<u4").tobytes(), crc)
                        offset, n = offset + take, n - take
                    crcs.append(crc)
                starts = pa.array(rows.column("offset").to_numpy() + base, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), starts, rows.column("n_tokens"), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files: start counts the ids of all documents before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("part", "path", "index_path", "base")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "part").mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def read_sequences(manifest: DataFrame) -> DataFrame:
    """(part, row, ids, mask): every sequence of the files."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for part, path in zip(files.column("part").to_pylist(), files.column("path").to_pylist(), strict=True):
                reader, row = pa.ipc.open_file(random_access(path)), 0
                for k in range(reader.num_record_batches):
                    b = reader.get_batch(k)
                    lists = [b.column(c).cast(pa.list_(pa.int32())) for c in ("ids", "mask")]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), pa.array(range(row, row + b.num_rows), pa.int64()), *lists], ["part", "row", "ids", "mask"])
                    row += b.num_rows

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("part", "path").repartition(n, "part").mapInArrow(over, "part int, row long, ids array<int>, mask array<int>")


def token_file_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Write docs to token files in the shared folder and return what the files hold for each document."""
    return read_token_files(write_token_files(docs, path, shared_dir(docs.sparkSession, "token-files"), id_col, text_col, end_id), id_col)
