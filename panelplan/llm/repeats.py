"""Removal of repeated passages: every byte inside a string of MIN_BYTES bytes that also starts elsewhere.

1. Every window of MIN_BYTES bytes has an anchor: the rightmost of its GRAM-byte substrings with the
   smallest hash. Equal windows have equal anchors at the same place, so a repeat is always met among
   windows with the same anchor. Neighbouring windows with one anchor form a context: the bytes from
   the first window's begin to the last one's end. Each window is in exactly one context.
2. Contexts are grouped by their anchor; a group of one context that occurs once has nothing to be
   compared with. Of all others each distinct context is laid out, with how often it occurs.
3. Groups are dealt by anchor. A task lays out as many as fit PART_BYTES, sorts their suffixes into a
   Burrows-Wheeler transform, and expands intervals breadth first: prepending a byte to all strings of
   length l gives the intervals of length l + 1, and each boundary met for the first time has common
   prefix l. It stops at MIN_BYTES: boundaries never met lie between suffixes that share at least that
   much, so both begin a repeated string. Copies of a context are one row each in the transform, which
   counts as several suffixes.
4. A group that is larger than PART_BYTES is dealt again by what stands beside the anchor: its windows
   are cut into classes by how many bytes they have left of the anchor, and the bytes that all windows
   of a class hold are the key of a smaller group. Classes get narrower from level to level; at the
   last one a group is a single string. Every group ends in a transform.

Repeated windows of one context all hold its anchor, so together they cover one run of bytes.

Rows: null texts are empty; matches never cross documents, and texts shorter than MIN_BYTES lose
nothing; a repeated row is another document with the same text; null ids are ids like any other.
Very long texts are read in tiles and a text of any length is whole to the comparison. Tables without
rows give none. Columns of docs keep their names; those that the result adds replace columns of the
same names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelplan.llm.common import written
from panelplan.llm.memory import slices, tidy

MIN_BYTES = 400
GRAM = 128
PART_BYTES = 1_000_000
_TILE = 1 << 18
#: Bits of a place: a transform has fewer than 2^21 symbols, so that two ranks and a place fit a sort key.
_PLACE = 21
_MASK = np.int64((1 << _PLACE) - 1)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of `width` values."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of each run of `gram` (a power of two from 8 on) bytes."""
    n = len(data) - 7
    h = np.empty(n, np.uint64)
    raw = data.tobytes()
    for s in range(min(8, n)):
        h[s::8] = np.frombuffer(raw, "<u8", len(range(s, n, 8)), s)
    width, odd = 8, np.uint64(0x9E3779B97F4A7C15)
    while True:
        h = h * odd
        h ^= h >> np.uint64(29)
        if width == gram:
            return (h * odd >> np.uint64(32)).astype(np.uint32)
        h = h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + h[width:]
        width *= 2


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = MIN_BYTES, gram: int = GRAM, tile: int = _TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for all windows of `size` bytes inside [starts, ends) of data."""
    width = size - gram + 1
    found = []
    for t0 in range(0, len(data) - size + 1, tile):
        t1 = min(t0 + tile, len(data) - size + 1)  # windows that begin in [t0, t1)
        v = gram_hashes(data[t0 : t1 + size - 1], gram)
        low = _slide(v, width, np.minimum)
        pad = np.zeros(width - 1, np.uint32)
        is_least = np.flatnonzero(_slide(np.concatenate((pad, low, pad)), width, np.maximum) == v)
        a, b = np.maximum(starts - t0, 0), np.minimum(ends - size - t0, t1 - t0 - 1)  # first and last window of each text
        a, b = a[a <= b], b[a <= b]
        if not len(a):
            continue
        cut = np.empty(len(low) + 1, bool)
        cut[0] = cut[-1] = True
        np.not_equal(low[1:], low[:-1], out=cut[1:-1])
        cut[a] = True
        cut[b + 1] = True
        edge = np.flatnonzero(cut)
        first, last = edge[:-1], edge[1:] - 1
        text = np.searchsorted(a, first, side="right") - 1
        inside = (text >= 0) & (first <= b[np.maximum(text, 0)])
        first, last = first[inside], last[inside]
        value = low[first].astype(np.uint64) << np.uint64(32)
        keys = np.sort((v[is_least].astype(np.uint64) << np.uint64(32)) | is_least.astype(np.uint64))
        lo = np.searchsorted(keys, value | first.astype(np.uint64))
        hi = np.searchsorted(keys, value | (last + width - 1).astype(np.uint64), side="right")
        n = hi - lo
        run = np.repeat(np.arange(len(n)), n)
        which = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + lo[run]
        p = (keys[which] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        after = np.full(len(p), 1 << 62)
        same = run[1:] == run[:-1]
        after[:-1][same] = p[1:][same]
        begin, end = np.maximum(first[run], p - width + 1), np.minimum(last[run], after - width)
        ok = begin <= end
        found.append((p[ok] + t0, begin[ok] + t0, end[ok] + t0))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _anchor_rows(size: int, gram: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column("text").cast(pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else memoryview(b"")
            offsets = offsets - offsets[0]
            p, a, b = anchors(np.frombuffer(raw, np.uint8), offsets[:-1], offsets[1:], size, gram)
            row = np.searchsorted(offsets[1:], a, side="right")
            kh = np.array([_signed(xxhash.xxh3_64_intdigest(raw[x : x + gram])) for x in p.tolist()], np.int64)
            ctx = [xxhash.xxh3_128_digest(raw[x : y + size]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            base = offsets[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("th").take(take), pa.array(a - base, pa.int32()), pa.array(b - a, pa.int32()), pa.array(p - a, pa.int32()), pa.array(kh), pa.array(ctx, pa.binary())],
                ["id", "th", "a", "more", "at", "kh", "ctx"],
            )

    return tidy(over)


_CONTEXT = pa.schema([("g", pa.int64()), ("s", pa.binary()), ("n", pa.int32()), ("data", pa.binary())])
_PIECE = pa.schema([("g", pa.int64()), ("s", pa.binary()), ("n", pa.int32()), ("data", pa.binary()), ("kh", pa.int64()), ("ctx", pa.binary()), ("lo", pa.int32()), ("at", pa.int32())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, of which the fourth value is the data, in batches of about `size` bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[3])
        if total > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def classes(data: bytes, at: int, size: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Windows of a context by how many bytes they have before its anchor, `width` such counts to a class:
    (class, first window, last window, begin and end of the bytes that all windows of the class hold)."""
    for c in range(max(0, at - (len(data) - size)) // width, at // width + 1):
        first, last = max(0, at - (c * width + width - 1)), min(len(data) - size, at - c * width)
        yield c, first, last, at - c * width, at - (c * width + width - 1) + size


def _pieces(kh: int, ctx: bytes, lo: int, at: int, n: int, data: bytes, size: int, width: int) -> Iterator[tuple]:
    for c, first, last, begin, end in classes(data, at, size, width):
        piece = data[first : last + size]
        group = _signed(xxhash.xxh3_64_intdigest(b"%d %d %d " % (kh, width, c) + data[begin:end]))
        yield group, xxhash.xxh3_128_digest(piece), n, piece, kh, ctx, lo + first, at - first


def _context_bytes(size: int, width: int | None = None):
    """The bytes of the contexts that `marks` names; with a width, cut into classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for text, marks in zip(batch.column("text").cast(pa.binary()), batch.column("marks"), strict=True):
                raw = text.as_py()
                for m in marks.as_py():
                    data = raw[m["a"] : m["a"] + m["more"] + size]
                    if width is None:
                        yield m["kh"], m["ctx"], m["n"], data
                    else:
                        yield from _pieces(m["kh"], m["ctx"], 0, m["at"], m["n"], data, size, width)

    return tidy(lambda batches: _batches(rows(batches), _CONTEXT if width is None else _PIECE))


def _cut(size: int, width: int):
    """Pieces cut into narrower classes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in (part for whole in batches for part in slices(whole, "data")):
            for r in batch.to_pylist():
                yield from _pieces(r["kh"], r["ctx"], r["lo"], r["at"], r["n"], r["data"], size, width)

    return tidy(lambda batches: _batches(rows(batches), _PIECE))


def suffix_order(byte: np.ndarray, marks: np.ndarray, least: int) -> np.ndarray:
    """Suffixes in order of their first `least` symbols or more, by doubling; those at `marks`, which end
    the texts, are symbols smaller than any byte, each of its own, in order."""
    n = len(byte)
    counts = np.bincount(byte, minlength=256)
    counts[0] -= len(marks)
    code = np.cumsum(counts > 0)
    bits = max(1, int(code[-1]).bit_length())
    length = 42 // bits
    letter = code[byte]
    letter[marks] = 0
    key = np.zeros(n, np.int64)
    for j in range(min(length, n)):
        key <<= bits
        key[: n - j] |= letter[j:]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(marks - length + 1, 0), 1)
    np.add.at(edge, marks + 1, -1)
    alone = np.cumsum(edge[:n]) > 0  # a mark within reach tells a suffix from all others, and marks are in the order of places
    place, new = np.arange(n), np.zeros(n, bool)
    while True:
        packed = np.sort(key << _PLACE | place)
        order = packed & _MASK
        packed >>= _PLACE
        np.not_equal(packed[1:], packed[:-1], out=new[1:])
        if alone is not None:
            new[1:] |= alone[order[1:]]
            alone = None
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if length >= least or rank[order[-1]] == n - 1:
            return order
        key = rank << _PLACE
        key[: n - length] |= rank[length:] + 1
        length *= 2


def long_repeats(texts: list[bytes], size: int, times: list[int] | None = None) -> np.ndarray:
    """Which positions of the texts, laid end to end with a mark behind each, begin a string of `size`
    bytes that also begins at another position.

    times: how often each text is there. Suffixes of its copies are neighbours in the transform and stay so
    whatever is prepended, so one row stands for all of them, as far as they reach before their marks."""
    m = len(texts)
    lengths = np.array([len(t) + 1 for t in texts])
    marks = np.cumsum(lengths) - 1
    byte = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n = len(byte)
    if n >> _PLACE:
        raise ValueError("too many bytes for one transform")
    order = suffix_order(byte, marks, size)
    symbol = byte.astype(np.int64) + m
    symbol[marks] = np.arange(m)
    packed = np.sort(symbol[order - 1] << _PLACE | np.arange(n))  # the transform, by symbol; the first text's begin follows the last mark
    by_symbol = (packed & _MASK).astype(np.int32)
    packed >>= _PLACE
    to = np.empty(n, np.int32)
    to[by_symbol] = np.arange(n, dtype=np.int32)  # row of the suffix that begins one symbol earlier
    same = packed[1:] == packed[:-1]
    last_seen, next_seen = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    last_seen[by_symbol[1:][same]] = by_symbol[:-1][same]
    next_seen[by_symbol[:-1][same]] = by_symbol[1:][same]
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    low, high, single = np.array([0], np.int32), np.array([n - 1], np.int32), np.empty(0, np.int32)
    for _ in range(size):  # common prefixes of 0, 1, ... size - 1
        single = to[single]  # an interval of one row has one image
        single = single[~met[single + 1]]
        wide = high - low + 1
        before = (low - np.cumsum(wide) + wide).astype(np.int32)
        row = np.arange(int(wide.sum()), dtype=np.int32) + np.repeat(before, wide)
        begins, ends = last_seen[row] < np.repeat(low, wide), next_seen[row] > np.repeat(high, wide)
        # of one interval and symbol, the first row's image begins the new interval and the last row's ends it
        low, high = np.sort(to[row[begins]]), np.sort(to[row[ends]])
        new = ~met[high + 1]
        low, high = low[new], high[new]
        met[high + 1] = True
        met[single + 1] = True
        one = low == high
        single = np.concatenate((single, low[one]))
        low, high = low[~one], high[~one]
        if not len(low) and not len(single):
            break
    shared = ~met[:-1] | ~met[1:]
    if times is not None:  # intervals of one row that stands for several suffixes
        left = np.repeat(marks, lengths) - np.arange(n)
        shared |= (np.repeat(np.array(times) > 1, lengths) & (left >= size))[order]
    out = np.zeros(n, bool)
    out[order[shared]] = True
    return out


def _repeated_runs(size: int, part_bytes: int):
    """From rows (g, s, n, data) in the order of g and s: the repeated run (lo, hi) of each s that has one."""

    def of(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
        starts = np.cumsum([0] + [len(r[3]) + 1 for r in rows[:-1]])
        at = np.flatnonzero(long_repeats([r[3] for r in rows], size, [r[2] for r in rows]))
        owner = np.searchsorted(starts, at, side="right") - 1
        which, first = np.unique(owner, return_index=True)
        last = np.append(first[1:], len(at)) - 1 if len(which) else first
        lo, hi = at[first] - starts[which], at[last] - starts[which] + size
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in which], pa.int64()), pa.array([rows[k][1] for k in which], pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["g", "s", "lo", "hi"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []
        total = 0
        for batch in batches:
            for g, s, n, data in zip(*[batch.column(c).to_pylist() for c in ("g", "s", "n", "data")], strict=True):
                if held and held[-1][0] == g and held[-1][1] == s:
                    continue  # repeated rows give theirs twice
                if held and held[-1][0] != g and total > part_bytes:
                    yield of(held)
                    held, total = [], 0
                held.append((g, s, n, data))
                total += len(data) + 1
        if held:
            yield of(held)

    return tidy(over)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (id, th, text, row): id and the text's hash tell rows apart even where ids repeat."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))


def _compared(rows: DataFrame, size: int, part_bytes: int) -> DataFrame:
    """(g, s, lo, hi): rows (g, s, n, data) compared within their groups, each of them in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g", "s").mapInArrow(_repeated_runs(size, part_bytes), "g long, s binary, lo int, hi int")


def _any(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def widths(size: int, gram: int) -> list[int]:
    """How many window places a class has, level after level: half of all, then a quarter of that, down to one."""
    found = [-(-(size - gram + 1) // 2)]
    while found[-1] > 1:
        found.append(-(-found[-1] // 4))
    return found


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = MIN_BYTES, gram: int = GRAM, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, th, spans): byte spans to remove, not merged yet, by id and hash of the text."""
    keyed = _keyed(docs, id_col, text_col).select("id", "th", "text")
    found = written(keyed.mapInArrow(_anchor_rows(size, gram), "id long, th long, a int, more int, at int, kh long, ctx binary"), "anchors")
    contexts = written(found.groupBy("kh", "ctx").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n"), F.min(F.struct("id", "th", "a", "more", "at")).alias("w")), "contexts")
    groups = contexts.groupBy("kh").agg(F.sum("n").alias("total"), F.sum(F.col("w.more") + size + 1).alias("bytes")).filter("total > 1")
    wide = written(groups.filter(F.col("bytes") > part_bytes).select("kh"), "wide-groups")

    def bodies(chosen: DataFrame, width: int | None, schema: str) -> DataFrame:
        marks = contexts.join(chosen, "kh").groupBy("w.id", "w.th").agg(F.collect_list(F.struct("kh", "ctx", "n", "w.a", "w.more", "w.at")).alias("marks"))
        one = keyed.join(marks, ["id", "th"]).groupBy("id", "th").agg(F.first("text").alias("text"), F.first("marks").alias("marks"))  # repeated rows have the same marks
        return one.select("text", "marks").mapInArrow(_context_bytes(size, width), schema)

    runs = _compared(bodies(groups.filter(F.col("bytes") <= part_bytes).select("kh"), None, "g long, s binary, n int, data binary"), size, part_bytes)
    verdict = runs.select(F.col("g").alias("kh"), F.col("s").alias("ctx"), "lo", "hi")
    if _any(wide):
        piece = "g long, s binary, n int, data binary, kh long, ctx binary, lo int, at int"
        pieces = bodies(wide, widths(size, gram)[0], piece)
        for width in widths(size, gram):
            pieces = written(pieces, "pieces")
            sizes = pieces.groupBy("g", "s").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.max(F.octet_length("data")).alias("length"))
            groups = written(sizes.groupBy("g").agg(F.sum("n").alias("total"), F.sum(F.col("length") + 1).alias("bytes")).filter("total > 1"), "piece-groups")
            fits = F.col("bytes") <= part_bytes if width > 1 else F.lit(True)  # the last groups hold one string each
            distinct = pieces.join(groups.filter(fits).select("g"), "g", "left_semi").groupBy("g", "s").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.first("data").alias("data"))
            runs = _compared(distinct, size, part_bytes).withColumnsRenamed({"lo": "from", "hi": "to"})
            verdict = verdict.unionByName(pieces.join(runs, ["g", "s"]).select("kh", "ctx", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi")))
            left = groups.filter(~fits).select("g")
            if width == 1 or not _any(left):
                break
            following = widths(size, gram)[widths(size, gram).index(width) + 1]
            pieces = pieces.join(left, "g", "left_semi").select("kh", "ctx", "lo", "at", "n", "data").mapInArrow(_cut(size, following), piece)
        verdict = verdict.groupBy("kh", "ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    verdict = written(verdict, "verdicts")
    hits = found.join(verdict, ["kh", "ctx"]).select("id", "th", F.struct((F.col("a") + F.col("lo")).alias("start"), (F.col("a") + F.col("hi")).alias("end")).alias("span")).distinct()  # repeated rows have the same spans
    return hits.groupBy("id", "th").agg(F.collect_list("span").alias("spans"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _strip(as_text: bool, with_bytes: bool):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            starts, ends, kept, sizes = [], [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans").to_pylist(), strict=True):
                raw, merged, parts, now = text.as_py(), _merged(spans or []), [], 0
                for s, e in merged:
                    parts.append(raw[now:s])
                    now = e
                parts.append(raw[now:])
                kept.append(b"".join(parts))
                sizes.append(len(raw))
                starts.append([s for s, _ in merged])
                ends.append([e for _, e in merged])
            columns = {"row": batch.column("row"), "n_bytes": pa.array(sizes, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))}
            columns["kept"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            if with_bytes:
                columns["kept_bytes"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return tidy(over)


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = True, with_bytes: bool = False, **how) -> DataFrame:
    """The columns of docs but the text, and n_bytes, starts, ends (of the removed runs, in bytes) and
    kept: what is left, as text (without characters that a run cuts) or as bytes; with_bytes adds
    kept_bytes beside the text."""
    spans = repeat_spans(docs, id_col, text_col, **how)
    new = ["n_bytes", "starts", "ends", "kept", *["kept_bytes"] * with_bytes]
    keyed = _keyed(docs.drop(*[c for c in new if c not in (id_col, text_col)]), id_col, text_col)
    row = keyed.schema["row"].dataType.simpleString()
    joined = keyed.join(spans, ["id", "th"], "left").select("row", "text", "spans")
    schema = f"row {row}, n_bytes long, starts array<int>, ends array<int>, kept {'string' if as_text else 'binary'}{', kept_bytes binary' * with_bytes}"
    return joined.mapInArrow(_strip(as_text, with_bytes), schema).select("row.*", *new)
