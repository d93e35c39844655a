"""Byte-level BPE by a pair occurrence index.

The distinct words of a batch are laid out as one linked list of symbols. An index maps each active
pair (by its merge rank) to all its positions; ranks are applied in ascending order, each to all its
positions at once, and the pairs beside the merged places are entered under their ranks. Entries
that an earlier merge has outdated are dropped when their rank comes up. Words and their ids are
kept for the partition, so that each distinct word is merged once.

Special tokens' strings in a text become their ids, as the tokenizers library does by default.

Rows: null texts are empty: no ids, decoded to the empty text; repeated rows and null ids are rows like
any other; very long texts are encoded whole (their words are taken one after another, the ids in one
array); tables without rows give none. Columns that the result adds replace those of the same names."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelplan.llm.memory import Lists, slices, tidy

#: Fixed value: the byte-level pre-tokenizer's split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for Latin-1 texts without the characters that Python's classes sort otherwise (x1C-x1F, superscripts, fractions).
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LATIN = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")
#: The word table is emptied beyond so many words, and when a partition ends; ids do not depend on it.
KEPT_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 letters for
    themselves, the other bytes, in order, for the letters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class BpeModel:
    """Merge table and vocabulary of a byte-level BPE file (the tokenizers library's JSON)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.base = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.base[b] = vocab[letter]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.same = left == right
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1) if len(self.keys) else np.full(len(key), -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.base[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = n  # n: no neighbour
        before[(ends - sizes)[sizes > 0]] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[after[places] < n]
            ranks = self.rank_of(symbol[places], symbol[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(part)

        enter(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            parts = index.pop(rank)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.rank_of(symbol[at], symbol[after[at]]) == rank]
            if not len(at):
                continue
            if self.same[rank] and len(at) > 1:  # runs of one symbol merge from the left, two by two
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                run = np.cumsum(~chained) - 1
                first = np.flatnonzero(~chained)
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            gone = after[at]
            symbol[at] = self.merged[rank]
            alive[gone] = False
            onward = after[gone]
            after[at] = onward
            inner = onward < n
            before[onward[inner]] = at[inner]
            back = before[at]
            enter(np.unique(np.concatenate((at, back[back < n]))))
        word = np.repeat(np.arange(len(words)), sizes)
        keep = alive[:n]
        return symbol[keep], np.bincount(word[keep], minlength=len(words))


class BpeEncoder:
    """Encodes batches of texts; keeps the ids of words seen."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.split = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None
        self.marks = sorted({t[0] for t in model.special})  # a text without any of these letters holds no special token
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)
        self.ids = Lists()
        for token, i in self.model.special.items():
            self.place[f"\0{token}"]  # cannot be met as a word: the mark is followed by other classes
            self.ids.append(np.array([i]), np.array([1]))

    def _words(self, text: str) -> Iterable[str]:
        if any(m in text for m in self.marks) and self.specials.search(text):
            return self._around_specials(text)
        split = self.split if _NOT_LATIN.search(text) else _LATIN
        if len(text) < 1 << 22:
            return split.findall(text)
        return (m.group() for m in split.finditer(text))  # without a list of all words of a very long text

    def _around_specials(self, text: str) -> Iterator[str]:
        at = 0
        for m in self.specials.finditer(text):
            yield from self.split.findall(text[at : m.start()])
            yield f"\0{m.group()}"
            at = m.end()
        yield from self.split.findall(text[at:])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.ids) > KEPT_WORDS:
            self._forget()
        place = self.place.__getitem__
        rows = [np.fromiter(map(place, self._words(t or "")), np.int64) for t in texts]
        if len(self.place) > len(self.ids):
            new = list(self.place)[len(self.ids) :]
            self.ids.append(*self.model.encode_words([w.encode() for w in new]))
        return [self.ids.take(row).astype(np.int32) for row in rows]


_ENCODERS: dict[str, BpeEncoder] = {}


def _encoder(held) -> BpeEncoder:
    key = hashlib.sha256(held.value.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = BpeEncoder(BpeModel(held.value))
    return _ENCODERS[key]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def encoded(batches: Iterator[pa.RecordBatch], held, slice_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Add a column `ids` to batches with a column `text`."""
    encoder = _encoder(held)
    for part in (part for batch in batches for part in slices(batch, rows=slice_rows, size=4 << 20)):
        yield part.append_column("ids", _lists(encoder.encode(part.column("text").to_pylist())))
    encoder._forget()  # the worker may serve other stages next


def decoded(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Add a column `decoded` to batches with a column `ids`: bytes of the tokens, wrong UTF-8 replaced. Null ids: null."""
    table = _encoder(held).model.bytes_of
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        valid = ids.is_valid().to_pylist()
        texts = [b"".join(map(table.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace") if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
        yield batch.append_column("decoded", pa.array(texts, pa.string()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array(np.diff(offsets), pa.int64()),
                pa.array([sha(",".join(map(str, flat[a:b].tolist())).encode()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]),
                pa.array([sha(t.encode()).hexdigest() for t in batch.column("decoded").to_pylist()]),
            ],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _broadcast(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:  # a vocabulary file on the driver, a few MB whatever the data
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with its token ids (array<int>) in out_col; a column of that name is replaced."""
    held, names = _broadcast(df, path), [c for c in df.columns if c != out_col]
    rows = df.select(F.col(text_col).alias("text"), F.struct(*names).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(tidy(lambda it: (b.select(["row", "ids"]) for b in encoded(it, held))), f"row {kind}, ids array<int>")
    return done.select("row.*", F.col("ids").alias(out_col))


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """df with the text of its token ids in out_col; a column of that name is replaced."""
    held, names = _broadcast(df, path), [c for c in df.columns if c != out_col]
    rows = df.select(F.col(ids_col).cast("array<int>").alias("ids"), F.struct(*names).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(tidy(lambda it: (b.select(["row", "decoded"]) for b in decoded(it, held))), f"row {kind}, decoded string")
    return done.select("row.*", F.col("decoded").alias(out_col))


def _checked(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    for b in decoded(encoded(batches, held), held):
        same = [x == (y or "") for x, y in zip(b.column("decoded").to_pylist(), b.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("ids"), pa.array(same)], ["row", "ids", "lossless"])


def bpe_encode_checked(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with `ids` and `lossless` (whether they decode to the text), in one pass; columns of these names are replaced."""
    held, names = _broadcast(df, path), [c for c in df.columns if c not in ("ids", "lossless", text_col)]
    rows = df.select(F.col(text_col).alias("text"), F.struct(*names).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(tidy(lambda it: _checked(it, held)), f"row {kind}, ids array<int>, lossless boolean").select("row.*", "ids", "lossless")


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, and both digested, in one pass."""
    held = _broadcast(df, path)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInArrow(tidy(lambda it: _digests(decoded(encoded(it, held), held))), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.withColumnRenamed("id", id_col)
