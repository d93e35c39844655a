"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("panelplan.llm")

import public_tokenizers
from tokenizers import Tokenizer

from panelplan.llm import bpe, decontaminate, language, neighbours, registry, repeats, simhash, token_files, toxicity, url_filter, warc
from panelplan.llm.common import min_component, shared_dir, table

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\x1c\x85", "a", "Ünï ① ١٢ 'sé 👩‍👩‍👧 <|endoftext|> x", "aaaa " * 3000, "the same words again and again " * 40, "the same words again and again " * 40]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null and long texts, and a column whose name an operator uses itself."""
    rows = [(k, t, "en") for k, t in enumerate(ODD)] + [(None, "no id", None), (3, "again id 3", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string").withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


# 1 ------------------------------------------------------------------------------------------


def slow_simhash(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_position_triples_cover_all_fours():
    from itertools import combinations

    triples = simhash.position_triples()
    assert len(triples) == 20 and all(any(set(t) <= set(q) for t in triples) for q in combinations(range(8), 4))


def components_by_force(prints: dict) -> dict:
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 4
    label = np.array(ids)
    while True:
        new = np.array([label[near[k]].min() for k in range(len(ids))])
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


@pytest.mark.parametrize("block", [simhash.BLOCK, 7])
def test_simhash_components_equal_brute_force(spark, block):
    docs = table(spark, SMALL, "documents")
    got = {r.doc_id: r for r in simhash.simhash_components(docs, block=block).collect()}
    prints = {r.doc_id: slow_simhash(r.text) for r in docs.collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == components_by_force(prints)


def test_chains_and_dense_lists_of_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {}
    for k in range(240):
        f = base[k % 3]
        for _ in range(k % 9):
            f ^= 1 << rng.randrange(24)
        prints[k] = f
    distinct = {}
    for k, f in prints.items():
        distinct.setdefault(f, k)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for f, k in distinct.items()], "fp long, rep long")
    want = components_by_force({k: f for f, k in distinct.items()})
    for block in (10_000, 16):
        found = {r.node: r.component for r in min_component(simhash.fingerprint_links(nodes, block=block)).collect()}
        assert {k: found.get(k, k) for k in want} == want


def test_simhash_odd_rows(odd, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(odd).collect()]
    assert len(got) == odd.count() and {f for i, f, c in got if i in (0, 1, 2)} == {"0" * 16}
    assert {c for i, _, c in got if i in (7, 8)} == {7}
    assert simhash.simhash_components(empty).count() == 0


# 2, 3 ---------------------------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        odds, first = rng.uniform(0.1, 5, n), np.zeros(n, bool)
        first[[0, *(rng.choice(n, 2) if n > 4 else [])]] = True
        start, step = rng.uniform(0.1, 2, 2), rng.uniform(0.1, 2, (2, 2))
        mass, joint, total = np.zeros(n), np.zeros((2, 2)), 0.0
        for path in range(1 << n):
            y = [path >> t & 1 for t in range(n)]
            w = np.prod([(start[y[t]] if first[t] else step[y[t - 1], y[t]]) * (odds[t] if y[t] else 1) for t in range(n)])
            total += w
            mass += w * np.array(y)
            for t in range(1, n):
                if not first[t]:
                    joint[y[t - 1], y[t]] += w
        one, pairs = toxicity.forward_backward(odds, first, start, step, True)
        assert np.allclose(one, mass / total) and np.allclose(pairs, joint / total)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "er", "ol", "ist", "une")]
    texts, labels = [], []
    for k in range(300):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if k % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["zurgon", "zurgel", "zurgists"]) + rng.choice(["", "a", "um"])
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit_model(texts[:200], labels[:200])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts[200:])], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    right = sum((got[k].score >= 0.5) == bool(labels[200 + k]) for k in range(100))
    assert right >= 95
    spans = [(k, texts[200 + k][s.start : s.end]) for k in range(100) for s in got[k].spans]
    assert all("zurg" in x and all(" " not in x or "zurg" in w for w in x.split()) for _, x in spans)  # no span holds a clean word
    marked = {k for k, _ in spans}
    assert sum((k in marked) == bool(labels[200 + k]) for k in range(100)) >= 95


def test_document_score_equals_enumeration():
    rng = np.random.default_rng(4)
    model = toxicity.ToxicModel(rng.normal(size=toxicity.BUCKETS) * 0.3, rng.uniform(0.2, 2, 2), rng.uniform(0.2, 2, (2, 2)), np.array([0.3, 0.7, -0.4]))
    texts = ["ab cd ef", "one", "", None, "x1 y2 ünder Wörter mixed CASE again ab", "-- 12 --"]
    want = []
    for text in texts:
        words = toxicity._WORD.findall(text or "")
        odds = [np.exp(sum(model.weights[b] for b in toxicity._bucketed(toxicity.word_features(w)))) for w in words]
        mass, total = np.zeros(len(words)), 0.0
        for path in range(1 << len(words)):
            y = [path >> t & 1 for t in range(len(words))]
            w = np.prod([(model.start[y[t]] if t == 0 else model.step[y[t - 1], y[t]]) * (odds[t] if y[t] else 1) for t in range(len(words))])
            total, mass = total + w, mass + w * np.array(y)
        one = mass / total
        top = min(max(max(one, default=0.0), 1e-4), 1 - 1e-4)
        want.append(1 / (1 + np.exp(-(0.3 + 0.7 * np.log(top / (1 - top)) - 0.4 * np.log(one.sum() + 1e-2)))))
    assert np.allclose(model.scores(model.marginals(texts)), want)


def test_marginals_of_long_texts_do_not_depend_on_tiles():
    rng = np.random.default_rng(5)
    odds, first = rng.uniform(0.01, 3, 5000), rng.random(5000) < 0.001
    first[0] = True
    start, step = rng.uniform(0.1, 2, 2), rng.uniform(0.1, 2, (2, 2))
    whole = toxicity.forward_backward(odds, first, start, step)[0]
    assert all(np.allclose(toxicity.token_marginals(odds, first, start, step, tile=t), whole) for t in (1, 7, 1000, 4999, 5000))


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (7, 0, "x"), (7, 1, "x"), (6, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train_toxicity(odd, labels)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train_toxicity(empty, labels)
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, model).count() == 0


def slow_phrases(reference: bytes, text: bytes) -> int:
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in reference:
            end += 1
        at = max(at + 1, end - 1)
        count += 1
    return count


def test_phrases_equal_a_slow_parse():
    rng = random.Random(2)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    references = {"x": make("abc ", 300), "y": make("abd ", 200), "z": b"q"}
    texts = [make("abcd qz", rng.randrange(1, 400)) for _ in range(30)] + [b"q", b"\xff\xfe"]
    got = language.Parser(references).phrases(texts)
    assert got.tolist() == [[slow_phrases(references[n], t) for t in texts] for n in "xyz"]


@pytest.mark.parametrize("piece", [language.PIECE, 7, 1])
def test_phrases_of_long_texts_do_not_restart(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    rng = random.Random(3)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)).encode()
    references = {"x": make("abc ", 300) * 4, "y": make("abd ", 200), "z": b"q" * 40}
    texts = [make("abcd q", n) for n in (12_000, 2048, 2049, 1, 4096)] + [references["x"] * 3, b"q" * 11_000, b""]
    got = language.Parser(references).phrases(texts)
    assert got.tolist() == [[slow_phrases(references[n], t) for t in texts] for n in "xyz"]


def test_only_letters_are_text(spark):
    texts = ["½", "²", "①", "Ⅷ", "㊀", "١٢", "_", "é", "ア", "x1", "\u0301"]
    got = language.Parser({"de": b"ein text", "en": b"a text"}).predict(texts)[0]
    assert [g == "und" for g in got] == [True] * 7 + [False] * 3 + [True]


def test_languages(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = registry.op3_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    rows = {(r.doc_id, r.lang_pred) for r in language.identify_language(odd, language.reference_texts(docs)).collect()}
    assert {(k, "und") for k in (0, 1, 2, 3)} <= rows
    assert {r.lang_pred for r in language.identify_language(odd, language.reference_texts(docs.filter("false"))).collect()} == {"und"}
    assert language.identify_language(empty, {"en": b"x"}).count() == 0


# 4 ------------------------------------------------------------------------------------------


def removed_by_force(texts: list[bytes], size: int) -> list[bytes]:
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def passages(seed: int) -> list[bytes]:
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdefgh", "é¶xyz "])
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(rng.randrange(20, 120)) for _ in range(3)]
    texts = ["".join(rng.choice([make(rng.randrange(60)), rng.choice(shared)]) for _ in range(rng.randrange(6))) for _ in range(24)]
    return [t.encode() for t in [*texts, "", "a" * 150, *texts[:3]]]


@pytest.mark.parametrize("part", [repeats.PART_BYTES, 300, 90])  # the smaller, the more groups are cut into classes
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed, part):
    texts = passages(seed)
    docs = spark.createDataFrame([(k // 2, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("copy", F.col("text"))
    got = repeats.repeats_removed(docs, size=40, gram=16, part_bytes=part, as_text=False).collect()
    want = Counter(zip((t.decode() for t in texts), removed_by_force(texts, 40), strict=True))
    assert Counter((r["copy"], bytes(r.kept)) for r in got) == want
    assert all(r.n_bytes - sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) == len(r.kept) for r in got)


def test_transform_equals_counting():
    for seed in range(60):
        rng = random.Random(seed)
        letters = rng.choice(["ab", "abcdé", "\x00a\x01", "".join(map(chr, range(300)))])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))).encode() for _ in range(rng.randrange(1, 12))]
        texts += [*texts[:2], texts[0][3:] + texts[-1]]
        seen = Counter(t[i : i + 13] for t in texts for i in range(len(t) - 12))
        assert repeats.long_repeats(texts, 13).tolist() == [seen[t[i : i + 13]] > 1 for t in texts for i in range(len(t) + 1)]


def test_a_passage_of_many_contexts_and_texts_over_a_tile(spark):
    """A passage just under the length in every document, with other bytes around it, cut level after level; texts of several tiles."""
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common, long = make(39), make(3000)
    texts = [make(rng.randrange(30)) + common + rng.choice("xyz") * (k % 3) + make(rng.randrange(30)) for k in range(150)] + [long, make(500) + long[700:2900] + make(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in repeats.repeats_removed(docs, size=40, gram=16, part_bytes=120).collect()}
    assert [got[k].encode() for k in range(len(texts))] == removed_by_force([t.encode() for t in texts], 40)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    of_windows = [{w: p for p, a, b in zip(*(x.tolist() for x in repeats.anchors(data, ends - [len(t) for t in texts], ends, 40, 16, tile=tile)), strict=True) for w in range(a, b + 1)} for tile in (1 << 18, 64)]
    assert of_windows[0] == of_windows[1] and len(of_windows[0]) == sum(max(0, len(t) - 39) for t in texts)


def test_repeats_odd_rows(odd, empty):
    both = repeats.repeats_removed(odd.withColumn("kept", F.lit(1)), with_bytes=True).collect()
    assert len(both) == odd.count() and all(r.kept == r.kept_bytes.decode() for r in both)
    got = repeats.repeats_removed(odd)
    assert got.count() == odd.count() and {r.kept for r in got.filter("doc_id IN (7, 8)").collect()} == {""}
    assert repeats.repeats_removed(empty).count() == 0


# 5, 7 ---------------------------------------------------------------------------------------

PIECES = ["abc", "aaaaaa", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "'s", "'LL", "é", "e\u0301", "漢字", "١٢", "½", "²", "<|endoftext|>", "<|startoftext|>", "İ", "Σς", "ß", "_", "--", "don't", "42"]


def mixed_texts(n: int) -> list[str]:
    rng = random.Random(4)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n)] + ["a" * 5001, "ab" * 2000, ""]


def test_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        model = bpe.BpeModel(f.read())
    texts = mixed_texts(1500)
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.BpeEncoder(model).encode(texts)] == want


def test_bpe_round_trip_and_odd_rows(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.bpe_round_trip(odd, path).collect()}
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        found = got[r.doc_id, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert (found.n_tokens, found.decoded_sha256) == (len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    back = bpe.bpe_decode(bpe.bpe_encode(odd, path), path, out_col="back")
    assert back.filter("back <> coalesce(text, '')").count() == 0 and back.count() == odd.count()
    assert bpe.bpe_round_trip(empty, path).count() == 0


def test_chunked_encoder_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        encoder = token_files.ChunkEncoder(f.read(), 1)
    texts = mixed_texts(1500)
    want = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert encoder.by_piece and [x.tolist() for x in encoder.encode(texts)] == want


def test_token_files_round_trip(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    manifest = token_files.write_token_files(docs, path, shared_dir(spark, "tokens"), length=64)
    got = {r.doc_id: r for r in token_files.read_token_files(manifest).collect()}
    start, every = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start, every = start + len(ids), every + ids
    rows = token_files.read_sequences(manifest).orderBy("part", "row").collect()
    assert {len(r.ids) for r in rows} == {64} and [i for r in rows for i, m in zip(r.ids, r["mask"], strict=True) if m] == every
    again = token_files.token_file_digests(odd, path).collect()
    assert len(again) == odd.count() and min(r.start for r in again) == 0
    assert token_files.token_file_digests(empty, path).count() == 0


def test_token_files_of_an_id_that_fills_several(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(7, f"text number {k}") for k in range(60)] + [(None, f"no id {k}") for k in range(60)] + [(k, f"row {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_token_files(docs, path, shared_dir(spark, "tokens"), files=8)
    assert manifest.filter("n_docs > 0").count() == 8 and manifest.agg(F.max("n_docs")).first()[0] < 45
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, crc(t)) for i, t in rows)


# 6 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", [97, 1000, 1 << 22])
def test_warc_ranges_own_each_record_once(spark, split):
    rng = random.Random(6)
    html = ["x" * 500, "y" * 99, None, "", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" + "z" * 200, "".join(chr(rng.randrange(32, 900)) for _ in range(3000))]
    rows = [(k, f"http://a/{k}\n é", html[k % len(html)], "u") for k in range(40)] + [(None, None, "x" * 500, "u"), (2, "u", "y" * 99, "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    files = warc.write_warc(pages, shared_dir(spark, "warc"))
    got = warc.read_warc(files, split).collect()
    first = {}
    for k, _, h, _ in rows:
        if h and len(h.encode()) >= 100 and k is not None:
            first[h] = min(first.get(h, k), k)
    want = Counter()
    for k, _, h, _ in rows:
        again = h in first and k != first[h]
        want[k, "revisit" if again else "response", first[h] if again else None, None if again else (h or "").encode()] += 1
    assert Counter((r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want


def test_warc_inner_members_are_not_records():
    inner = zlib.compressobj(0, zlib.DEFLATED, 31)
    body = inner.compress(warc.record("response", 7, None, b"inner", "0", 5, None, "d")) + inner.flush()
    outer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the inner member's bytes show
    data = outer.compress(warc.record("response", 1, "u", body + b"!" * 50, "0", 5, None, "d")) + outer.flush()
    source = warc._Source(pa.BufferReader(data * 3), 3 * len(data))
    got = [warc._parsed(c)[0] for s in range(0, source.size, 50) for c in warc.members(source, s, min(s + 50, source.size))]
    assert got == [1, 1, 1]


def test_warc_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_round_trip(pages).count() == 0


# 8 ------------------------------------------------------------------------------------------


def test_neighbours_reach_the_recall_of_brute_force(spark):
    e = table(spark, "/root/testdata/sf0.1", "embeddings").limit(3000)
    rows = sorted((r.vec_id, r.embedding) for r in e.collect())
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got: dict = {}
    for r in neighbours.nearest_neighbours(e, F.col("id") % 100 == 0, list_block=100, query_block=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((data - data[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        assert sorted(got[q]) == list(range(1, 11))
        hit, total = hit + len(best & {v for v, _ in got[q].values()}), total + 10
        assert all(abs(d[ids == v][0] - s) < 1e-12 for v, s in got[q].values())
    assert hit / total >= 0.9


def test_neighbours_of_copies_and_small_lists(spark):
    """A vector that a third of the rows hold, and far-off rows whose lists hold fewer vectors than are asked for."""
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(300)] + [(k, rng.normal(size=3).tolist()) for k in range(300, 890)] + [(k, [1e3 * k, 0.0, 1.0]) for k in range(890, 902)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got: dict = {}
    for r in neighbours.nearest_neighbours(df, F.col("id") % 50 == 0, probes=1, lists=24, list_block=64, query_block=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert all(sorted(got[q]) == list(range(1, 11)) for q in ids[ids % 50 == 0].tolist())
    for q in range(0, 300, 50):
        assert [got[q][k] for k in range(1, 11)] == [k for k in range(11) if k != q][:10]
    d = np.sqrt(((data - data[ids == 900][0]) ** 2).sum(axis=1))
    assert set(got[900].values()) <= set(ids[np.argsort(d)][:40].tolist())


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (200, [1.0]), (None, [1.0, 1.0]), (2, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = [tuple(r) for r in neighbours.nearest_neighbours(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert got[0][3] == 0 and abs(got[2][3] - 5**0.5) < 1e-12
    assert neighbours.nearest_neighbours(df.filter("false"), F.col("id") % 100 == 0).count() == 0


# 9 ------------------------------------------------------------------------------------------


def hits_by_force(text: str | None, items: dict) -> tuple[int, int, set]:
    words = decontaminate.words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items.items():
        w = decontaminate.words_of((body or "").encode())
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for s in range(len(words) - k + 1):
                if words[s : s + k] == w[i : i + k]:
                    hit |= set(range(s, s + k))
                    found.add(item)
    return len(words), len(hit), found


@pytest.mark.parametrize("shard", [decontaminate.SHARD_WINDOWS, 7])
def test_decontamination_equals_brute_force(spark, shard):
    rng = random.Random(9)
    words = ["a", "b", "Cé", "d1"]
    make = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(words) for _ in range(n))
    items = {str(k): make(n) for k, n in enumerate([1, 2, 3, 12, 13, 14, 30, 40, 0])} | {"n": None}
    items["again"] = items["6"]
    texts = [None, "", "-", *[make(rng.randrange(60)) for _ in range(12)], f"{make(50)} {items['6'].upper()} {make(300)}", items["7"]]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, starts int")
    bench = spark.createDataFrame([*items.items(), (None, "a b")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.benchmark_hits(docs, bench, shard_windows=shard).collect()}
    for k, t in enumerate(texts):
        n, hit, found = hits_by_force(t, items)
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0 and 20 * hit >= n), t
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontaminate.benchmark_hits(docs, bench.filter("false")).filter("n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(docs.filter("false"), bench).count() == 0


def test_another_benchmark_is_not_searched_with_the_last_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "id", lambda held: 1, raising=False)  # as where an address is used again
    docs = spark.createDataFrame([(1, "one two"), (2, "three four")], "doc_id long, text string").coalesce(1)
    for text, want in (("one two", {1}), ("three four", {2}), ("one two", {1})):
        bench = spark.createDataFrame([("i", text)], "item_id string, text string")
        assert {r.doc_id for r in decontaminate.benchmark_hits(docs, bench).filter("contaminated").collect()} == want


def test_ten_benchmarks_in_one_session(spark):
    docs = spark.createDataFrame([(k, f"a word{k} b") for k in range(10)], "doc_id long, text string").coalesce(1)
    for k in range(10):
        bench = spark.createDataFrame([("i", f"word{k}")] if k % 4 else [], "item_id string, text string")
        got = {r.doc_id for r in decontaminate.benchmark_hits(docs, bench).filter("n_hit > 0").collect()}
        assert got == ({k} if k % 4 else set())


def test_stages_on_empty_tables_and_extra_columns(spark):
    import corpus_pipeline

    few = table(spark, SMALL, "documents").limit(30)
    wide = few.withColumn("row", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("score", F.lit(2.0)).withColumn("kept", F.lit("k")).withColumn("ids", F.lit(3)).withColumn("fp", F.lit(4))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, SMALL).columns == wide.columns, name
        assert stage(spark, wide.filter("false"), SMALL).count() == 0, name
        assert stage(spark, wide, SMALL).count() > 0, name
    assert corpus_pipeline.encode_tokens(spark, wide, SMALL).count() == 30 and corpus_pipeline.encode_tokens(spark, wide.filter("false"), SMALL).count() == 0


def test_stages_decide_by_row(spark, odd, tmp_path):
    """Null and repeated ids: each row is kept or dropped for its own text."""
    import corpus_pipeline

    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    all_rows, where = texts(odd), str(tmp_path)
    want = Counter({(None, "no id"): 1, (0, None): 1, (3, "again id 3"): 1} | {(k, ODD[k]): 1 for k in (3, 4, 5, 6, 7)})
    assert texts(simhash.near_duplicates_removed(odd)) == want  # all but copies of (0, null) and (7, ...)
    assert texts(simhash.near_duplicates_removed(odd.unionByName(odd.filter("doc_id is not null")))) == want
    assert texts(simhash.near_duplicates_removed(odd.unionByName(odd.filter("doc_id is null")))) == want + Counter([(None, "no id")])

    spark.createDataFrame([("b", "no id"), ("c", "again id 3")], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    clean = texts(corpus_pipeline.drop_contaminated(spark, odd, where))
    assert clean == all_rows - Counter([(None, "no id"), (3, "again id 3")])

    docs = table(spark, SMALL, "documents")
    model = toxicity.train_toxicity(docs, table(spark, SMALL, "labels"))
    toxic = toxicity.score_toxicity(docs, model).filter("score >= 0.5").join(docs, "doc_id").first()["text"]
    mixed = docs.limit(40).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(toxic).alias("text"), *docs.columns[2:]))
    mixed = mixed.unionByName(docs.limit(1).withColumn("text", F.lit(toxic)))
    left = corpus_pipeline.drop_toxic(spark, mixed.unionByName(docs.filter("doc_id > 40")), SMALL)
    assert left.filter(F.col("text") == toxic).count() == 0 and left.columns == docs.columns


# 10 -----------------------------------------------------------------------------------------


def test_url_rules_and_model(spark):
    urls = {
        None: ("", "", None), "no scheme": ("", "", None), "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/"), "http://net/": ("net", "/", "net/"), "http://xnet/": ("xnet", "/", None),
        "https://b.example.com/de/1#f": ("b.example.com", "/de/1", "example.com/de/"), "https://a.org/fr/?x": ("a.org", "/fr/", "org/fr/"), "http://a.net": ("a.net", "", None), "http://a.net?x://y": ("a.net", "", None), "x://y://z/p": ("y:", "//z/p", None),
    }
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.url: r for r in url_filter.filter_urls(pages).collect()}
    assert {u: (got[u].host, got[u].path, got[u].rule) for u in urls} == urls
    assert got["http://net/"].verdict == "block" and got["https://a.org/fr/?x"].verdict == "allow"
    labelled = spark.createDataFrame([(f"http://spam{k}.biz/win", 1) for k in range(20)] + [(f"http://school{k}.edu/read", 0) for k in range(20)], "url string, label int")
    test = spark.createDataFrame([(1, "http://spam99.biz/win"), (2, "http://school77.edu/read"), (3, "http://" + "x" * 20_000)], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(test, labelled, rules=[]).orderBy("page_id").collect()][:2] == ["block", "allow"]
    assert url_filter.filter_urls(test.filter("false")).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(test).collect()} == {"allow"}


def grams_by_force(host: str, path: str, buckets: int) -> set[int]:
    text = f"^{host} {path}$"
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return {signed(xxhash.xxh64_intdigest(text[i : i + n].encode(), 42)) % buckets for n in url_filter.GRAMS for i in range(len(text) - n + 1)}


def test_url_probabilities_equal_brute_force(spark):
    rng = random.Random(8)
    weights = [rng.uniform(-1, 1) for _ in range(256)]
    urls = [("", ""), ("a", ""), ("münchen.de", "/ä?"), ("x" * 3000, "/y" * 50), *[("".join(rng.choice("abc.") for _ in range(rng.randrange(12))), "/" + "".join(rng.choice("abc/") for _ in range(rng.randrange(12)))) for _ in range(20)]]
    df = spark.createDataFrame([(k, h, p) for k, (h, p) in enumerate(urls)], "k int, host string, path string")
    for r in df.withColumn("p", url_filter.block_probability(F.col("host"), F.col("path"), weights, 0.3)).collect():
        logit = 0.3 + sum(weights[b] for b in grams_by_force(r.host, r.path, 256))
        assert abs(r.p - 1 / (1 + np.exp(-logit))) < 1e-12


def test_url_model_on_held_out_pages(spark):
    """Fitted to pages that the rules decide, but for those held out, it says the same of these as the rules."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url").filter("url is not null")
    host, path = url_filter.url_parts(F.col("url"))
    rule, verdict = url_filter.matched_rule(F.col("host"), F.col("path"), url_filter.RULES)
    known = pages.withColumn("host", host).withColumn("path", path).withColumn("label", (verdict == "block").cast("int")).filter("label is not null")
    held = F.crc32(F.col("url").cast("binary")) % 5 == 0
    got = url_filter.filter_urls(known.filter(held).drop("host", "path"), known.filter(~held).select("url", "label"), rules=[])
    right, n, kinds = got.agg(F.avg(((F.col("verdict") == "block").cast("int") == F.col("label")).cast("int")), F.count("*"), F.count_distinct("label")).first()
    assert n > 50 and kinds == 2 and right > 0.95


def test_url_rows_repeated_rare_labels_and_sql(spark):
    urls = [("http://a.biz/x", 1)] * 3 + [(f"http://ok{k}.edu/read", 0) for k in range(300)] + [("http://a.biz/y", 1), (None, 1), ("http://n.edu", None)]
    labelled = spark.createDataFrame(urls, "url string, label int")
    pages = spark.createDataFrame([(1, "http://a.biz/z"), (1, "http://a.biz/z"), (None, "http://ok999.edu/read")], "page_id long, url string")
    got = url_filter.filter_urls(pages, labelled, rules=[]).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["allow", "block", "block"]
    assert url_filter.fit_url_model(labelled, rows=5)[0] != [0.0] * url_filter.BUCKETS  # the rare label is in the sample
    import duckdb

    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])))
    sql = f"""SELECT page_id, host, path, CASE {fits} END AS rule FROM (SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM (
        SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM '/root/testdata/sf0.01/pages.parquet')))"""
    want = sorted(duckdb.sql(sql).fetchall())
    assert sorted(tuple(r) for r in registry.op10_url_filter(spark, "/root/testdata/sf0.01").select("page_id", "host", "path", "rule").collect()) == want


# pipeline -----------------------------------------------------------------------------------


def test_pipeline_equals_the_stages_by_force(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table(spark, SMALL, "labels"))).collect() if r.score >= 0.5}
    rows = {k: v for k, v in rows.items() if k not in toxic}
    parts = components_by_force({k: slow_simhash(v["text"]) for k, v in rows.items()})
    rows = {k: v for k, v in rows.items() if parts[k] == k}
    keys = sorted(rows)
    kept = removed_by_force([rows[k]["text"].encode() for k in keys], corpus_pipeline.PASSAGE_BYTES)
    texts = {k: t.decode("utf-8", "ignore") for k, t in zip(keys, kept, strict=True)}
    items = {str(r.item_id): r.text for r in table(spark, SMALL, "benchmark").collect()}
    clean = {k for k, t in texts.items() if not (lambda n, h: h > 0 and 20 * h >= n)(*hits_by_force(t, items)[:2])}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: library.encode(texts[k], add_special_tokens=False).ids for k in clean}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {k: r.ids for k, r in got.items()} == want and all(r.lossless for r in got.values())
