"""op4_repeats on a table with passages just under and just at the 400 bytes of its contract."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("panelplan.llm")

from panelplan.llm import registry

SIZE = 400


def expected(texts: list[bytes]) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting every string of SIZE bytes."""
    seen = Counter(t[i : i + SIZE] for t in texts for i in range(len(t) - SIZE + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - SIZE + 1):
            if seen[t[i : i + SIZE]] > 1:
                gone[i : i + SIZE] = b"\1" * SIZE
        spans = sum(g and not before for before, g in zip(b"\0" + gone, gone, strict=False))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_passages_of_over_50_words_go_from_400_bytes_on(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(3, 8))) for _ in range(n))

    def passage(size: int) -> str:
        text = prose(80).encode()[:size].decode("utf-8", "ignore")
        text += "x" * (size - len(text.encode()))
        assert len(text.split()) > 50
        return text

    under, at = passage(SIZE - 1), passage(SIZE)
    rows = [f"1 {prose(30)} <{under}> {prose(20)}", f"2 {prose(9)} ({under}) {prose(40)}", f"3 {prose(30)} <{at}> {prose(20)}", f"4 {prose(9)} ({at}) {prose(40)}", at, prose(200), None, ""]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op4_repeats(spark, str(tmp_path)).collect()}
    want = expected([(t or "").encode() for t in rows])
    assert [tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for k in range(len(rows))] == want
    assert [got[k].n_removed for k in range(len(rows))] == [0, 0, SIZE, SIZE, SIZE, 0, 0, 0]
    assert got[0].text == rows[0] and got[2].text == rows[2].replace(at, "") and got[4].text == ""
