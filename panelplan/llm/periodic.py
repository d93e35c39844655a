"""Periodic runs of words: stretches that repeat their first q words, found and collapsed.

A suffix automaton grows by a word at a time. Its tree of suffix links is kept in preferred paths (a
link-cut tree): all strings that end at the newest word lie on the path from its state to the root, and a
preferred path holds states whose strings ended at the same word last. Access to the newest state cuts and
joins these paths, and tells of each segment where its strings ended before: a string of length l or more
that ended at i - q and ends at i again is a square if l >= q, and the longest one of the segment is where
the stretch of period q begins. q is then the smallest period of the stretch: with a smaller one the
string would have ended later than i - q. The stretch is extended to the right word by word, once for each run.

Words that are in no run are not appended: a run of length max(MIN_WORDS, MIN_TIMES * q) or more holds each
of its GRAM-word windows twice or more, so only stretches covered by repeated windows are searched (windows
are compared by hash; an equal hash of different ones only makes a stretch longer). Stretches are
narrowed by the windows repeated in the stretch itself, at most NARROWINGS times.

A text is searched whole in the task that holds it; texts are distributed as they are and nothing is shuffled.

Rows: null texts, and texts without words, have no runs, null numbers and the hashes of the empty string;
repeated rows and those with a null id give a row each; tables without rows give none. Columns beyond id
and text are not carried over, so their names do not clash."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelplan.llm.common import let
from panelplan.llm.memory import slices, tidy

MIN_WORDS, MIN_TIMES = 6, 4
#: Windows of 4 words: a run of 6 words or more and 4 periods or more holds each of its own twice.
GRAM = 4
NARROWINGS = 8
#: What separates words, for Spark; bytes.split() separates at the same characters.
BLANK_PATTERN = r"[\x20\x09-\x0D]+"


class LinkCutAutomaton:
    """Suffix automaton of a sequence of numbers, its suffix links kept as a link-cut tree.

    left, right, up: the splay trees of preferred paths, by depth; up of a root is the state above its path.
    ended: for the root of a splay tree, where the strings of its path ended last."""

    def __init__(self):
        self.after: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.left, self.right, self.up, self.ended = [-1], [-1], [-1], [-1]
        self.last = 0

    def _new(self, after: dict[int, int], length: int, link: int) -> int:
        self.after.append(after)
        self.length.append(length)
        self.link.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(link)
        self.ended.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        if y < 0 or (left[y] != x and right[y] != x):
            return
        top = y
        while (z := up[top]) >= 0 and (left[z] == top or right[z] == top):
            top = z
        self.ended[x] = self.ended[top]
        while y >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                self._rotate(y if (left[y] == x) == (left[z] == y) else x)
            self._rotate(x)
            y = up[x]

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[y], up[x] = x, z

    def append(self, c: int) -> int:
        """Add a number; its state."""
        after, link, length = self.after, self.link, self.length
        p = self.last
        now = self._new({}, length[p] + 1, 0)
        while p >= 0 and c not in after[p]:
            after[p][c] = now
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 != length[q]:
                copy = self._new(dict(after[q]), length[p] + 1, link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = copy
                # the copy ended where q did: it joins q's path just above it
                self._splay(q)
                above = self.left[q]
                self.left[copy], self.left[q], self.up[copy] = above, copy, q
                if above >= 0:
                    self.up[above] = copy
                q = copy
            link[now] = self.up[now] = q
        self.last = now
        return now

    def access(self, v: int, place: int) -> list[tuple[int, int]]:
        """Make the path from v to the root one that ended at `place`. (where it ended before, longest string) of each segment."""
        right, up, ended = self.right, self.up, self.ended
        found, below, x = [], -1, v
        while x >= 0:
            self._splay(x)
            if x != v:
                found.append((ended[x], self.length[x]))
            cut = right[x]
            if cut >= 0:
                ended[cut] = ended[x]
            right[x] = below
            below = x
            x = up[x]
        ended[below] = place
        self._splay(v)
        return found


def runs_of(numbers: list[int], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of length max(min_words, min_times * period) or more; min_times is 2 or more."""
    tree, runs, reach, n = LinkCutAutomaton(), [], {}, len(numbers)
    for i, c in enumerate(numbers):
        for e, longest in tree.access(tree.append(c), i):
            q = i - e
            if e < 0 or q > longest or reach.get(q, -1) >= i:
                continue
            end = i + 1
            while end < n and numbers[end] == numbers[end - q]:
                end += 1
            reach[q] = end - 1
            start = e - longest + 1
            if end - start >= max(min_words, min_times * q):
                runs.append((start, end - start, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _repeated_stretches(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words covered by GRAM-word windows that their own stretch holds twice or more.

    owner: the number of the text of each word; windows that reach over two texts count for none. What is
    left after NARROWINGS rounds may hold words that are in no run; it loses none that are."""
    place, group = np.arange(len(words)), owner
    for _ in range(NARROWINGS):
        n = len(words) - GRAM + 1
        if n < 1:
            return []
        key = group[:n].astype(np.uint64)
        for k in range(GRAM):
            key = (key ^ (key >> np.uint64(29))) * _ODD + words[k : n + k].astype(np.uint64)
        key = (key ^ (key >> np.uint64(32))) * _ODD
        whole = np.flatnonzero(group[:n] == group[GRAM - 1 :])
        order = whole[np.argsort(key[whole], kind="stable")]
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.unique(np.concatenate((order[1:][equal], order[:-1][equal])))
        cover = np.bincount(twice, minlength=len(words) + 1) - np.bincount(twice + GRAM, minlength=len(words) + 1)
        inside = np.cumsum(cover[:-1]) > 0
        breaks = np.concatenate(([False], (np.diff(group) != 0) | ~inside[:-1]))
        group = np.cumsum(breaks)[inside]
        if inside.all():
            break
        words, place = words[inside], place[inside]
    if not len(place):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    return list(zip(place[first].tolist(), (place[np.append(first[1:], len(place)) - 1] + 1).tolist(), strict=True))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with periods put into the texts of a tenth of the ids.

    With h = crc32 of the id as text, a multiple of 10, and g = h / 10, the n words from number a = g % n on
    repeat the first 1 + (n - a) / (3 + g % 8) of them. Other texts, and those of a null id, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.expr("__h div 10")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")))

    words = F.filter(F.split(F.col(text_col), BLANK_PATTERN), lambda x: x != "")
    text = F.when(F.col("__h") % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col(text_col)))).otherwise(F.col(text_col))
    return docs.withColumn("__h", h).withColumn(text_col, text).drop("__h")


def _found(keep_text: bool, min_words: int, min_times: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            number: dict[bytes, int] = defaultdict(count().__next__)
            texts = part.column("text").cast(pa.binary())
            docs = [(t.as_py() or b"").split() for t in texts]
            sizes = np.array([len(w) for w in docs], np.int64)
            flat = np.fromiter((k for w in docs for k in map(number.__getitem__, w)), np.int64, int(sizes.sum()))
            begin = np.cumsum(sizes) - sizes
            runs: list[list[tuple[int, int, int]]] = [[] for _ in docs]
            for s, e in _repeated_stretches(flat, np.repeat(np.arange(len(docs)), sizes)):
                if e - s >= min_words:
                    k = int(np.searchsorted(begin, s, side="right")) - 1
                    runs[k] += [(s - int(begin[k]) + at, length, q) for at, length, q in runs_of(flat[s:e].tolist(), min_words, min_times)]
            rows = []
            for words, found in zip(docs, runs, strict=True):
                found.sort(key=lambda r: (r[0], r[2]))
                kept = words
                if found:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for s, length, q in found:
                        drop[s + q] += 1
                        drop[s + length] -= 1
                    kept = [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]
                rows.append((found, b" ".join(kept)))
            ends = [[r[k] for r in found] for k in range(3) for found, _ in rows]
            lists = [pa.array(ends[k * len(rows) : (k + 1) * len(rows)], pa.list_(pa.int64())) for k in range(3)]
            digests = [hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest() for found, _ in rows]
            collapsed = [hashlib.sha256(kept).hexdigest() for _, kept in rows]
            columns = dict(zip(["id", "starts", "lengths", "periods", "runs_sha256", "collapsed_sha256"], [part.column("id"), *lists, pa.array(digests, pa.string()), pa.array(collapsed, pa.string())], strict=True))
            if keep_text:
                columns["collapsed"] = pa.array([kept for _, kept in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return tidy(over)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """(id_col, runs, runs_sha256, collapsed_sha256) of each document, and `collapsed` with keep_text.

    runs: (start, length, period) in words, by start and period; collapsed: the words without those that a
    run repeats, joined by one blank."""
    if min_times < MIN_TIMES or min_words < MIN_WORDS:
        raise ValueError(f"runs shorter than {MIN_WORDS} words or {MIN_TIMES} periods may hold no window of {GRAM} words twice")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    lists = "starts array<long>, lengths array<long>, periods array<long>"
    found = rows.mapInArrow(_found(keep_text, min_words, min_times), f"id {kind}, {lists}, runs_sha256 string, collapsed_sha256 string{', collapsed string' * keep_text}")
    runs = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")))
    return found.select(F.col("id").alias(id_col), runs.alias("runs"), "runs_sha256", "collapsed_sha256", *["collapsed"] * keep_text)


def longest_run(runs: DataFrame) -> DataFrame:
    """periodic_runs with n_runs, and start, length, period and exponent_milli of the longest run (ties: first start, then period)."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    top = F.when(F.size("runs") > 0, best)
    out = runs.withColumn("n_runs", F.size("runs").cast("long")).withColumn("top", top)
    return out.select("*", F.col("top.start"), (-F.col("top.short")).alias("length"), F.col("top.period"), F.expr("1000 * -top.short div top.period").alias("exponent_milli")).drop("top")
