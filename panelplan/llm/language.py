"""Language identification by cross-parsing entropy.

The labelled text of each language is indexed by a suffix automaton. A text is parsed from left to
right into phrases, each the longest match that the automaton knows (or a single unknown byte); the
language whose phrases, times the bits that point to one (log2 of its labelled text's length), are
fewest wins; ties go to the smaller name.

A reference text has at most REFERENCE_BYTES bytes of whole documents, at most REFERENCE_DOCS of them,
those with the smallest hash, or else the shortest document of the language, whole; that is the bound of
the fitted sample, and no more than REFERENCE_DOCS rows of a language reach the driver. Automata are built in the workers
from these texts and laid out as transition tables, so that the parses of many texts advance one byte in
a few array operations.

A text is one parse from its first byte to its last, however long. So that a long one does not advance
alone, it is read in pieces side by side, each at first as if a phrase began with it; then each piece
is read again from the state that its predecessor ended in, until both readings are in the same state
(from there on they are one), and the count before that is replaced. A reading that never meets the
first one gives the next piece another state to begin with, and that one is read again in turn.

Rows: null texts, and texts without a letter (Unicode category L), are `und` with score 0; null languages
and documents with a null id teach nothing; without any labelled text all is `und`. Repeated rows are
predicted each, and count once among the labelled ones, as do equal texts of one id; different texts of an id count each; tables without rows give none. Columns of the same names as the result's are not
carried over."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelplan.llm.common import top_k
from panelplan.llm.memory import slices, tidy

REFERENCE_BYTES = 30_000
REFERENCE_DOCS = 48
PIECE = 2048
_LETTER = regex.compile(r"\p{L}")
#: A-Z lowered; ASCII that is no letter becomes a blank; the other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STATE = (1 << 28) - 1


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of each state (0: the start); a path from the start spells each substring of data."""
    after, link, length, last = [{}], [-1], [0], 0
    for c in data:
        now = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = now
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return after


class Parser:
    """Transition tables of all languages, one after another: an entry is the next state, and above
    bit 28 how many phrases end on the way."""

    def __init__(self, references: dict[str, bytes]):
        self.names = sorted(references)
        folded = {k: v.translate(_FOLD) for k, v in references.items()}
        used = sorted(set(b"".join(folded.values())))
        self.symbol = np.zeros(256, np.int16)  # 0: in no reference
        for k, b in enumerate(used):
            self.symbol[b] = k + 1
        self.width = len(used) + 1
        tables, self.roots, base = [], [], 0
        for name in self.names:
            states = suffix_automaton(folded[name])
            table = np.full((len(states), self.width), -1, np.int64)
            for s, to in enumerate(states):
                for c, t in to.items():
                    table[s, self.symbol[c]] = base + t
            begin = np.where(table[0] >= 0, table[0], base)  # where a new phrase with this byte leads
            unknown = table[0] < 0
            failed = table < 0
            table = np.where(failed, begin + ((1 + unknown.astype(np.int64)) << 28), table)
            table[0] = np.where(unknown, base + (1 << 28), begin)
            tables.append(table.astype(np.int32))
            self.roots.append(base)
            base += len(states)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.empty(0, np.int32)
        self.bits = np.array([np.log2(max(2, len(folded[n]))) for n in self.names])

    def _read(self, letters: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Advance states (language, piece) over pieces, longest first (letters: place, piece); they end in the
        state behind each piece. Returns the phrases that ended."""
        live = np.searchsorted(-sizes, -np.arange(1, len(letters) + 1), side="right")  # pieces with a byte here
        found = np.zeros(state.shape, np.int32)
        for t, n in enumerate(live.tolist()):
            to = self.table[state[:, :n] * self.width + letters[t, :n]]
            found[:, :n] += to >> 28
            state[:, :n] = to & _STATE
        return found

    def _joined(self, letters: np.ndarray, sizes: np.ndarray, piece: np.ndarray, state: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read pieces from the given states beside their first reading. (how many phrases more have ended
        when both are in one state, or else behind the piece; the state there, -1 if both are in one)."""
        more, end = np.zeros(len(piece), np.int32), np.full(len(piece), -1, np.int32)
        rest = np.arange(len(piece))
        for t in range(int(sizes[piece].max(initial=0))):
            over = sizes[piece[rest]] == t
            end[rest[over]] = state[over]
            going = ~over & (state != first)
            rest, state, first = rest[going], state[going], first[going]
            if not len(rest):
                return more, end
            symbol = letters[t, piece[rest]]
            to, one = self.table[state * self.width + symbol], self.table[first * self.width + symbol]
            more[rest] += (to >> 28) - (one >> 28)
            state, first = to & _STATE, one & _STATE
        apart = state != first
        end[rest[apart]] = state[apart]
        return more, end

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases by language and text."""
        pieces = [(k, t[at : at + PIECE]) for k, t in enumerate(texts) for at in range(0, len(t), PIECE)]
        counts = np.zeros((len(self.names), len(texts)), np.int64)
        if not pieces:
            return counts
        owner = np.array([k for k, _ in pieces])
        order = np.argsort([-len(p) for _, p in pieces], kind="stable")
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))  # the column of each piece
        sizes = np.array([len(pieces[k][1]) for k in order])
        letters = np.zeros((len(pieces), sizes[0]), np.uint8)
        for row, k in zip(letters, order.tolist(), strict=True):
            row[: len(pieces[k][1])] = np.frombuffer(pieces[k][1], np.uint8)
        letters = np.ascontiguousarray(self.symbol[letters.T])
        roots = np.array(self.roots, np.int32)
        behind = np.repeat(roots[:, None], len(pieces), axis=1)
        found = self._read(letters, sizes, behind)
        begun, ends, change = np.repeat(roots[:, None], len(pieces), axis=1), behind.copy(), np.zeros(found.shape, np.int32)
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # pieces that follow another one of their text
        todo = np.array([(lang, k) for lang in range(len(roots)) for k in later.tolist()]).reshape(-1, 2)
        while len(todo):
            lang, column, before = todo[:, 0], place[todo[:, 1]], place[todo[:, 1] - 1]
            state = ends[lang, before]
            stale = state != begun[lang, column]  # last read from another state
            todo, lang, column, state = todo[stale], lang[stale], column[stale], state[stale]
            begun[lang, column] = state
            more, end = self._joined(letters, sizes, column, state, roots[lang])
            change[lang, column] = more
            ends[lang, column] = np.where(end < 0, behind[lang, column], end)
            todo = todo[np.isin(todo[:, 1] + 1, later)] + [0, 1]
        found += change
        final = np.append(np.flatnonzero(owner[1:] != owner[:-1]), len(pieces) - 1)  # the last piece of each text
        for lang in range(len(roots)):
            counts[lang] = np.bincount(owner, weights=found[lang, place], minlength=len(texts)).astype(np.int64)
            counts[lang, owner[final]] += ends[lang, place[final]] != roots[lang]
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        spoken = [bool(t and _LETTER.search(t)) and bool(self.names) for t in texts]
        known = [k for k, s in enumerate(spoken) if s]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known:
            return langs, scores
        cost = self.phrases([texts[k].encode("utf-8", "surrogatepass").translate(_FOLD) for k in known]) * self.bits[:, None]
        best = cost.argmin(axis=0)
        for j, k in enumerate(known):
            langs[k] = self.names[best[j]]
            others = np.delete(cost[:, j], best[j])
            scores[k] = float(others.min() / (others.min() + cost[best[j], j])) if len(others) else 1.0
        return langs, scores


def reference_texts(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = REFERENCE_DOCS, size: int = REFERENCE_BYTES) -> dict[str, bytes]:
    """Labelled text of each language: whole documents in the order of their ids' hash while they fit into `size` bytes.

    Documents of `size` bytes or more come last, the shortest first; the first document is taken whatever its size,
    so that a language of long documents only is learned from one whole document."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("th"), F.octet_length(text_col).alias("n"), F.col(text_col).alias("text"))
    over = F.when(F.col("n") >= size, F.col("n")).otherwise(0)
    keys = rows.select("lang", "id", "th", "n").distinct()  # repeated rows are one
    first = top_k(keys, ["lang"], [over, F.xxhash64("id"), F.col("id"), F.col("th")], docs, "k", spread=32).drop("n")
    chosen = rows.join(F.broadcast(first), ["lang", "id", "th"]).groupBy("lang", "id", "th", "k").agg(F.first("text").alias("text"))  # `docs` for each language
    out: dict[str, bytes] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["k"])):
        more = r["text"].encode() + b"\n"
        if r["lang"] not in out or len(out[r["lang"]]) + len(more) <= size:
            out[r["lang"]] = out.get(r["lang"], b"") + more
    return out


_PARSERS: dict[str, Parser] = {}


def _predict(held, key: str):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(held.value)
        for part in (part for batch in batches for part in slices(batch, size=1 << 20)):
            langs, scores = _PARSERS[key].predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return tidy(over)


def identify_language(docs: DataFrame, references: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each document; score: the runner-up's cost over the sum of both (0.5 to 1)."""
    held = docs.sparkSession.sparkContext.broadcast(references)  # REFERENCE_BYTES for each language
    key = hashlib.sha256(repr(sorted(references.items())).encode()).hexdigest()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predict(held, key), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def id_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds
