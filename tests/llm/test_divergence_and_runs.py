"""Source divergence and periodic runs against brute force and SQL, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelplan.llm")

from panelplan.llm import divergence, periodic, registry
from panelplan.llm.common import table

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\x1c\x85", "a", "Ünï ① 'sé 👩‍👩‍👧 <x> x", "aaaa " * 3000, "the same words again and again " * 40, "the same words again and again " * 40]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(ODD)] + [(None, "no id", None, None), (3, "again id 3", "de", None), (3, "again id 3", "de", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("id", F.lit("x")).withColumn("item", F.lit(1)).withColumn("n", F.lit("x"))


# 11 -----------------------------------------------------------------------------------------


def divergence_by_force(rows: list[tuple], min_docs: int, top: int) -> set[tuple]:
    docs = [(lang or "", source or "", re.findall(divergence.TERM_PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    in_docs, times, of_lang, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        in_docs[lang].update(set(words))
    kept = {lang: sorted(w for w, n in seen.items() if n >= min_docs) for lang, seen in in_docs.items()}
    for lang, source, words in docs:
        mine = [w for w in words if in_docs[lang][w] >= min_docs]
        times[lang, source].update(mine)
        of_lang[lang].update(mine)

    def p(counts: Counter, lang: str, w: str) -> int:
        return 1 + 10**9 * (counts[w] + 1) // (sum(counts.values()) + len(kept[lang]))

    out = set()
    for lang, sources in groups.items():
        for a in sources:
            mine = times[lang, a]
            p_a = {w: p(mine, lang, w) for w in kept[lang]}
            found = []
            for b in sources - {a}:
                other = times[lang, b]
                n, v = sum(other.values()), len(kept[lang])
                found.append((-sum((p_a[w] - q) ** 2 // q for w in kept[lang] for q in [1 + 10**9 * (other[w] + 1) // (n + v)]), b.encode()))
            out |= {(lang, a, "pair", b.decode(), -f, k + 1) for k, (f, b) in enumerate(sorted(found))}
            found = []
            for w in mine:
                q = p(of_lang[lang], lang, w)
                if p_a[w] > q:
                    found.append((-((p_a[w] - q) ** 2 // q), w.encode()))
            out |= {(lang, a, "term", w.decode(), -f, k + 1) for k, (f, w) in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize(("shard_terms", "block", "top"), [(1 << 16, 48, 200), (50, 2, 7)])
def test_divergence_equals_brute_force(spark, monkeypatch, shard_terms, block, top):
    rng = random.Random(shard_terms)
    words = [f"{rng.choice(['é', 'B', 'c', 'ß', 'Z'])}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None])) for _ in range(160)]
    rows += [("1 2 3", "xx", "alone"), (None, "yy", "a"), ("", "yy", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    found = divergence.source_divergence(docs, shard_terms=shard_terms, block=block, top=top)
    assert {tuple(r) for r in found.collect()} == divergence_by_force(rows, 3, top)


def test_a_task_gives_its_slots_away_when_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(divergence, "DENSE_SLOTS", 1)  # in this process: the generator is run here
    monkeypatch.setattr(divergence, "CACHE_TERMS", 1)
    docs = divergence._plain(table(spark, SMALL, "documents"), "text", "lang", "source")
    files = divergence.perfect_hash_files(divergence.kept_terms(docs), 300)
    where, shards = defaultdict(dict), {}
    for r in files.collect():
        where[r["lang"]][r["shard"]], shards[r["lang"]] = (r["path"], r["n_terms"]), r["shards"]
    batches = docs.toArrow().to_batches(max_chunksize=40)
    got: dict[tuple, Counter] = defaultdict(Counter)
    parts = 0
    for batch in divergence._recounted(dict(where), shards)(iter(batches)):
        for r in batch.to_pylist():
            at, n = divergence._vector(r["slots"], r["counts"])
            parts += 1
            got[r["lang"], r["source"], r["shard"]].update(dict(zip(at.tolist(), n.tolist(), strict=True)))
    want = {(r["lang"], r["source"], r["shard"]): r for r in divergence.recount(docs, files).collect()}
    assert parts > len(want) and set(got) == set(want)
    for key, r in want.items():
        at, n = divergence._vector(r["slots"], r["counts"])
        assert dict(got[key]) == dict(zip(at.tolist(), n.tolist(), strict=True)) and r["n"] == n.sum()


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash(n):
    terms = [f"t{k}".encode() for k in range(n)]
    laid = divergence.PerfectHash(terms)
    slots = laid.slots(terms, divergence.term_hashes(terms))
    assert sorted(slots.tolist()) == list(range(n)) and [laid.terms[s].as_py() for s in slots.tolist()] == terms
    others = [f"u{k}".encode() for k in range(3000)]
    assert (laid.slots(others, divergence.term_hashes(others)) == -1).all()


def test_terms_of_equal_hashes_have_slots(monkeypatch):
    monkeypatch.setattr(divergence, "term_hashes", lambda terms: np.full(len(terms), 7, np.uint64))
    terms = [b"a", b"b", b"c"]
    laid = divergence.PerfectHash(terms)
    assert sorted(laid.slots(terms, divergence.term_hashes(terms)).tolist()) == [0, 1, 2] and laid.slots([b"d"], divergence.term_hashes([b"d"])).tolist() == [-1]


def test_shares_beyond_64_bits():
    counts = np.array([0, 10**11, 3], np.int64)
    assert divergence.shares(counts, 2 * 10**11, 3).tolist() == [1 + 10**9 * (c + 1) // (2 * 10**11 + 3) for c in counts.tolist()]


def test_divergence_odd_rows(spark, odd):
    want = divergence_by_force([(r["text"], r["lang"], r["source"]) for r in odd.collect()], 3, 200)
    assert {tuple(r) for r in divergence.source_divergence(odd).collect()} == want
    assert divergence.source_divergence(odd.filter("false")).count() == 0


# 13 -----------------------------------------------------------------------------------------


def runs_by_force(w: list) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            s = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            length = i - s
            if length >= max(6, 4 * q) and not any(all(w[s + k] == w[s + k - d] for k in range(d, length)) for d in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(400):
        n = rng.randrange(70)
        w = [rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(3, 9)
            w = w[:a] + [w[a + k % p] for k in range(n - a)]
        want = runs_by_force(w)
        assert periodic.runs_of(w) == want
        owner = np.zeros(2 * n, np.int64)
        owner[n:] = 1  # a second text with the same words
        found = [(s, [(s + at, length, q) for at, length, q in periodic.runs_of((w + w)[s:e])]) for s, e in periodic._repeated_stretches(np.array(w + w, np.int64), owner)]
        assert sorted((r for s, rs in found if s < n for r in rs), key=lambda r: (r[0], r[2])) == want
        assert sorted(((s - n, length, q) for at, rs in found if at >= n for s, length, q in rs), key=lambda r: (r[0], r[2])) == want


def test_runs_of_a_long_text_take_linear_work():
    assert periodic.runs_of([0] * 100_000) == [(0, 100_000, 1)]
    assert periodic.runs_of([k % 1000 for k in range(50_000)]) == [(0, 50_000, 1000)]


def runs_row(doc_id: int | None, text: str | None) -> tuple:
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len([x for x in re.split("[\x20\x09-\x0d]+", text or "") if x])
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_force(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *top, digest, hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def test_periodic_runs_equal_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect() if len((r["text"] or "").split()) < 700}
    found = [tuple(r) for r in registry.op13_periodic_runs(spark, SMALL).collect()]
    assert len(found) == table(spark, SMALL, "documents").count()
    assert sorted(r for r in found if r[0] in docs) == sorted(runs_row(k, t) for k, t in docs.items())
    assert sum(r[1] > 0 for r in found) > 5


def test_periodic_runs_odd_rows(spark, odd):
    found = periodic.longest_run(periodic.periodic_runs(periodic.planted(odd), keep_text=True))
    assert found.columns[0] == "doc_id"
    got = [tuple(r) for r in found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    want = [runs_row(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 10_000]
    assert Counter(r for r in got if r[3] is None or r[3] < 2000) == Counter(want)
    assert [r["collapsed"] for r in found.filter("length >= 2000").collect()] == ["aaaa"]
    assert periodic.periodic_runs(odd.filter("false")).count() == 0
