"""Toxicity: a linear-chain conditional random field that tags toxic words.

Labels come by document, so tokens are labelled first: on the training sample, word features (the
word, its prefixes and suffixes) that occur in toxic documents and hardly in others are chosen until
they explain the toxic documents; in those, tokens with such a feature are toxic, all others clean.
The field (two states, hashed word features, transitions) is fitted to these labels by its exact
gradient. Scoring runs forward-backward over each whole text; the marginals give the toxic spans,
and their maximum and sum, put through a logistic curve fitted on sample documents kept from the
field's training, the document's score.

Forward-backward over all tokens of a batch is one chain of 2x2 matrices in which a document's
first matrix forgets what came before. It is cut into equal pieces whose products are taken side by
side, so the work is a few array operations per token however long a single text is; more tokens than
TILE are taken tile after tile, their products carried on, so that memory does not grow with a text.

The sample is at most SAMPLE_DOCS labelled documents of each class, those of up to SAMPLE_CHARS characters by
hash and then longer ones, the shortest first, whole, until the class has SAMPLE_DOCS * SAMPLE_CHARS characters;
it is the bound of what is learned from, and every text is scored whole.

Rows: null and empty texts have no tokens and get the lowest score that the curve gives; repeated label
rows of a document count once if they agree, and not at all if they differ; null labels and null ids
of labels are left out; equal texts count once, and not at all with both labels; without both classes every score is the share of toxic labels, or 0 without
labels. Repeated documents are scored each; tables without rows give none. Columns of the same names as
the result's are not carried over."""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelplan.llm.common import top_k
from panelplan.llm.memory import slices, tidy

SAMPLE_DOCS = 900
SAMPLE_CHARS = 10_000
BUCKETS = 1 << 17
KEPT_WORDS = 100_000
TILE = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    w = word.lower()
    return [f"W{w}"] + [f"P{w[:k]}" for k in range(2, 8) if len(w) > k] + [f"S{w[-k:]}" for k in range(3, 6) if len(w) > k]


def _bucketed(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in features]


def _pieces(odds: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The chain's matrices by (entry, place in the piece, piece); entry 2 i + j leads from state i to state j."""
    n = len(odds)
    length = max(16, int(np.sqrt(n)))
    rows = -(-n // length)
    m = np.empty((4, rows * length))
    scale = 1 / (1 + odds)
    for i in (0, 1):
        for j in (0, 1):
            m[2 * i + j, :n] = np.where(first, start[j], step[i, j]) * (odds * scale if j else scale)
    m[:, n:] = np.array([1.0, 0, 0, 1])[:, None]
    return np.ascontiguousarray(m.reshape(4, rows, length).transpose(0, 2, 1))


def _products(m: np.ndarray) -> tuple[np.ndarray, ...]:
    """The product of each piece, up to a factor."""
    rows = m.shape[2]
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(m.shape[1]):
        p, q, r, s = m[:, t]
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        z = 1 / (a + b + c + d)
        a, b, c, d = a * z, b * z, c * z, d * z
    return a, b, c, d


def _carried(products: tuple[np.ndarray, ...], enter: tuple[float, float], leave: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(what reaches each piece from the left, and one row more for what leaves the last; what reaches each from the right, and one more)."""
    a, b, c, d = (x.tolist() for x in products)
    into, back = np.empty((len(a) + 1, 2)), np.empty((len(a) + 1, 2))
    x, y = into[0] = enter
    for k in range(len(a)):
        x, y = x * a[k] + y * c[k], x * b[k] + y * d[k]
        x, y = into[k + 1] = x / (x + y), y / (x + y)
    x, y = back[-1] = leave
    for k in range(len(a) - 1, -1, -1):
        x, y = a[k] * x + b[k] * y, c[k] * x + d[k] * y
        x, y = back[k] = x / (x + y), y / (x + y)
    return into, back


def forward_backward(odds: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray, pairs: bool = False, enter: tuple[float, float] = (0.5, 0.5), leave: tuple[float, float] = (0.5, 0.5)):
    """Marginal of state 1 for each token, and with `pairs` the summed transition expectations (2x2).

    odds: the emission of state 1 over state 0; first: the first tokens of documents; start, step:
    positive weights of the first state and of transitions; enter, leave: what reaches the tokens from
    others before and behind them."""
    n = len(odds)
    if not n:
        return np.empty(0), np.zeros((2, 2))
    m = _pieces(odds, first, start, step)
    length, rows = m.shape[1:]
    into, back = _carried(_products(m), enter, leave)
    alpha, beta = np.empty((2, length, rows)), np.empty((2, length, rows))
    x, y = into[:-1].T
    for t in range(length):
        p, q, r, s = m[:, t]
        x, y = x * p + y * r, x * q + y * s
        z = 1 / (x + y)
        x, y = x * z, y * z
        alpha[0, t], alpha[1, t] = x, y
    x, y = back[1:].T
    for t in range(length - 1, -1, -1):
        beta[0, t], beta[1, t] = x, y
        p, q, r, s = m[:, t]
        x, y = p * x + q * y, r * x + s * y
        z = 1 / (x + y)
        x, y = x * z, y * z
    flat = lambda v: v.transpose(1, 0).reshape(-1)[:n]
    a0, a1, b0, b1 = flat(alpha[0]), flat(alpha[1]), flat(beta[0]), flat(beta[1])
    one = a1 * b1 / (a0 * b0 + a1 * b1)
    if not pairs:
        return one, None
    parts = m.transpose(0, 2, 1).reshape(4, -1)[:, 1:n]
    joint = np.stack([(a0, a1)[i][:-1] * parts[2 * i + j] * (b0, b1)[j][1:] for i in (0, 1) for j in (0, 1)])
    joint = (joint / joint.sum(axis=0))[:, ~first[1:]]
    return one, joint.sum(axis=1).reshape(2, 2)


def token_marginals(odds: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Marginals of any number of tokens, a tile at a time: the tiles' products first, then each tile with what reaches it."""
    cuts = range(0, len(odds), tile)
    if len(cuts) < 2:
        return forward_backward(odds, first, start, step)[0]
    whole = []
    for at in cuts:
        product = np.eye(2)
        for entries in zip(*_products(_pieces(odds[at : at + tile], first[at : at + tile], start, step)), strict=True):
            product = product @ np.array(entries).reshape(2, 2)
            product /= product.sum()
        whole.append(product)
    into, back = _carried(tuple(np.array([w[i, j] for w in whole]) for i in (0, 1) for j in (0, 1)), (0.5, 0.5), (0.5, 0.5))
    return np.concatenate([forward_backward(odds[at : at + tile], first[at : at + tile], start, step, enter=tuple(into[k]), leave=tuple(back[k + 1]))[0] for k, at in enumerate(cuts)])


class ToxicModel:
    """Weights of the field and of the score's curve; keeps the emissions of words seen."""

    def __init__(self, weights: np.ndarray, start: np.ndarray, step: np.ndarray, curve: np.ndarray, fixed: float | None = None):
        self.weights, self.start, self.step, self.curve, self.fixed = weights, start, step, curve, fixed
        self._forget()

    def __reduce__(self):
        return ToxicModel, (self.weights, self.start, self.step, self.curve, self.fixed)

    def _forget(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)
        self.emission = np.empty(0)

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, the marginal of each of its words."""
        if len(self.place) > KEPT_WORDS:
            self._forget()
        place = self.place.__getitem__
        rows = [np.fromiter(map(place, _WORD.findall(t or "")), np.int64) for t in texts]
        new = list(self.place)[len(self.emission) :]
        if new:
            found = [_bucketed(word_features(w)) for w in new]
            sizes = np.fromiter(map(len, found), np.int64)
            flat = self.weights[np.fromiter((i for x in found for i in x), np.int64)]
            self.emission = np.concatenate((self.emission, np.add.reduceat(flat, np.cumsum(sizes) - sizes)))
        sizes = np.array([len(r) for r in rows])
        if not sizes.sum():
            return [np.empty(0) for _ in rows]
        odds = np.exp(np.clip(self.emission[np.concatenate(rows)], -30, 30))
        first = np.zeros(len(odds), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return np.split(token_marginals(odds, first, self.start, self.step), np.cumsum(sizes)[:-1])

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(marginals), self.fixed)
        return 1 / (1 + np.exp(-np.clip(_aggregates(marginals) @ self.curve, -500, 500)))


def _aggregates(marginals: list[np.ndarray]) -> np.ndarray:
    top = np.array([m.max() if len(m) else 0.0 for m in marginals])
    total = np.array([m.sum() for m in marginals])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log(total + 1e-2)], axis=1)


def _explaining(docs: list[np.ndarray], toxic: np.ndarray, names: list[str]) -> np.ndarray:
    """Which features occur in toxic documents and hardly in others: those that together explain most
    toxic documents, and all that are frequent in toxic documents and occur in no other. docs: the
    numbers of the features of each document, each once."""
    n, size = int(toxic.sum()), len(names)
    seen = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
    for found, y in zip(docs, toxic.tolist(), strict=True):
        seen[y][found] += 1
    in_clean, in_toxic = seen
    sure = (in_toxic >= max(2, 0.005 * n)) & (in_clean <= 0.02 * in_toxic * (len(docs) - n) / max(n, 1))
    where: dict[int, set[int]] = {f: set() for f in np.flatnonzero(sure).tolist()}
    for k in np.flatnonzero(toxic).tolist():
        for f in docs[k][sure[docs[k]]].tolist():
            where[f].add(k)
    chosen, left = np.zeros(size, bool), set(np.flatnonzero(toxic).tolist())
    order = sorted(where, key=lambda f: (-len(where[f]), -len(names[f]), names[f]))
    while left and order:
        best, gain = None, 0
        for f in order:
            if len(where[f]) <= gain:
                break
            if (g := len(where[f] & left)) > gain:
                best, gain = f, g
        if best is None or gain < max(1, 0.003 * n):
            break
        chosen[best] = True
        left -= where[best]
    return chosen | (sure & (in_toxic >= max(8, 0.03 * n)) & (in_clean == 0))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def fit_model(texts: list[str], toxic: list[int], rounds: int = 60, rate: float = 0.25, decay: float = 1e-4) -> ToxicModel:
    """Fit field and curve to texts with labels 0 and 1."""
    y = np.array(toxic, bool)
    zero = np.zeros(3)
    if not len(y) or y.all() or not y.any():
        return ToxicModel(np.zeros(BUCKETS), np.ones(2), np.ones((2, 2)), zero, float(y.mean()) if len(y) else 0.0)
    words: dict[str, int] = defaultdict(count().__next__)
    rows = [np.fromiter(map(words.__getitem__, _WORD.findall(t)), np.int64) for t in texts]
    numbers: dict[str, int] = defaultdict(count().__next__)
    features = [[numbers[f] for f in word_features(w)] for w in words]
    owner = np.repeat(np.arange(len(features)), [len(x) for x in features])
    feature = np.fromiter((i for x in features for i in x), np.int64, len(owner))
    begins = np.searchsorted(owner, np.arange(len(features) + 1))

    def of_words(ids: np.ndarray) -> np.ndarray:
        sizes = begins[ids + 1] - begins[ids]
        return np.unique(feature[np.repeat(begins[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())])

    chosen = _explaining([of_words(np.unique(r)) for r in rows], y, list(numbers))
    marked = np.bincount(owner, weights=chosen[feature], minlength=len(features)) > 0
    for_field = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 4 > 0 for t in texts])
    used = [k for k, r in enumerate(rows) if len(r) and for_field[k]]
    model = ToxicModel(np.zeros(BUCKETS), np.ones(2), np.ones((2, 2)), zero)
    if used and marked.any():
        bucket = np.array(_bucketed(list(numbers)))[feature]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word, label, first) of whole documents, about a tile each
        sizes = np.cumsum([len(rows[k]) for k in used]) // (TILE // 2)
        for part in np.split(np.array(used), np.flatnonzero(np.diff(sizes)) + 1):
            word, n_words = np.concatenate([rows[k] for k in part]), np.array([len(rows[k]) for k in part])
            first = np.zeros(len(word), bool)
            first[np.cumsum(n_words) - n_words] = True
            parts.append((word, marked[word] & np.repeat(y[part], n_words), first))
        n_tokens = sum(len(p[0]) for p in parts)
        seen, begun = np.zeros((2, 2)), np.zeros(2)
        for _, label, first in parts:
            inner = ~first[1:]
            seen += [[((label[:-1] == i) & (label[1:] == j) & inner).sum() for j in (0, 1)] for i in (0, 1)]
            begun += [(~label[first]).sum(), label[first].sum()]
        w, trans, init = np.zeros(BUCKETS), np.array([[0.0, -1.0], [0.0, -1.0]]), np.array([0.0, -1.0])
        squares = [np.full_like(v, 1e-6) for v in (w, trans, init)]
        for _ in range(rounds):  # AdaGrad on the exact gradient
            emission = np.bincount(owner, weights=w[bucket], minlength=len(features))
            by_word, joint, p = np.zeros(len(features)), np.zeros((2, 2)), np.zeros(2)
            for word, label, first in parts:
                one, both = forward_backward(np.exp(np.clip(emission[word], -30, 30)), first, np.exp(init), np.exp(trans), True)
                by_word += np.bincount(word, weights=label - one, minlength=len(features))
                joint += both
                p += [(1 - one[first]).sum(), one[first].sum()]
            grads = np.bincount(bucket, weights=by_word[owner], minlength=BUCKETS) - decay * n_tokens * w / 1000, seen - joint, begun - p
            for v, g, s in zip((w, trans, init), grads, squares, strict=True):
                s += g * g
                v += rate * g / np.sqrt(s)
        model = ToxicModel(w, np.exp(init), np.exp(trans), zero)
    kept = [k for k in range(len(texts)) if not for_field[k]]
    if not kept or y[kept].all() or not y[kept].any():
        kept = list(range(len(texts)))
    found = np.concatenate([_aggregates(model.marginals([texts[k] for k in kept[at : at + 128]])) for at in range(0, len(kept), 128)])
    model.curve = _curve(found, y[kept].astype(float))
    model._forget()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list:
    """Rows (id, y, text) of each class, at most per_class, those whose id has the smallest hash.

    Texts of more than `chars` characters come after all shorter ones, the shortest first, and only while a class
    has not per_class * chars characters; its first text is taken whatever its length. A text counts once, with
    its smallest id; one that has both labels teaches nothing."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).filter("y = z and id is not null")
    if usable is not None:
        marks = marks.filter(usable)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.length(text_col).alias("n"), F.col(text_col).alias("text")).filter("n > 0")
    over = F.when(F.col("n") > chars, F.col("n")).otherwise(0)
    keys = rows.select("id", "th", "n").join(marks.select("id", "y"), "id").distinct()  # repeated rows are one
    first = top_k(keys, ["y"], [over, F.xxhash64("id"), F.col("id"), F.col("th")], per_class, "k", spread=32)
    held = F.sum("n").over(Window.partitionBy("y").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))  # per_class rows
    first = first.withColumn("held", held).filter((F.col("held") <= per_class * chars) | (F.col("k") == 1)).select("id", "th", "y")
    chosen = rows.join(F.broadcast(first), ["id", "th"]).groupBy("id", "th", "y").agg(F.first("text").alias("text"))  # per_class rows of two classes
    seen: dict[str, list] = defaultdict(list)
    for r in sorted(chosen.collect(), key=lambda r: (r["id"], r["text"])):
        seen[r["text"]].append(r)
    return [same[0] for same in seen.values() if len({r["y"] for r in same}) == 1]


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, **columns) -> ToxicModel:
    """A model from labels (id_col, label_col 0/1) and the texts of docs. usable: a condition on `id`
    that training rows must meet."""
    rows = labelled_sample(docs, labels, usable, **columns)
    return fit_model([r["text"] for r in rows], [int(r["y"]) for r in rows])


_MODELS: dict[str, ToxicModel] = {}


def _score(held, key: str, keep_text: bool):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = pickle.loads(held.value)
        model = _MODELS[key]
        for part in (part for batch in batches for part in slices(batch, rows=1024, size=1 << 20)):
            texts = part.column("text").to_pylist()
            marginals = model.marginals(texts)
            starts, ends = [], []
            for text, m in zip(texts, marginals, strict=True):
                hot = m >= 0.5
                spans = []
                if hot.any():
                    places = [w.span() for w in _WORD.finditer(text)]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hot.astype(np.int8), [0]))))
                    spans = [(places[a][0], places[b - 1][1]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
            out = pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(marginals), pa.float64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["id", "score", "starts", "ends"])
            yield out.append_column("text", part.column("text")) if keep_text else out
        model._forget()  # the worker may serve other stages next

    return tidy(over)


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id_col, score, spans), and text with keep_text: spans are the character offsets (start, end) of runs of toxic words."""
    packed = pickle.dumps(model)  # of fixed size: BUCKETS weights
    held = docs.sparkSession.sparkContext.broadcast(packed)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_score(held, hashlib.sha256(packed).hexdigest(), keep_text), f"id {kind}, score double, starts array<int>, ends array<int>{', text string' * keep_text}")
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end")))
    return found.select(F.col("id").alias(id_col), "score", spans.alias("spans"), *["text"] * keep_text)
