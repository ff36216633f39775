"""Removal of repeated byte passages against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from larder.llm import suffix_dedup

SCHEMA = "doc_id long, text string, spans string, node int"


def brute(rows, threshold):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + threshold] for x in raw for i in range(len(x) - threshold + 1))
    out = []
    for (k, _), x in zip(rows, raw, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - threshold + 1):
            if seen[x[i : i + threshold]] > 1:
                gone[i : i + threshold] = [True] * threshold
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, threshold):
    docs = spark.createDataFrame([(k, t, "mine", 7) for k, t in rows], SCHEMA)
    found = suffix_dedup.remove_repeats(docs, threshold)
    assert found.columns == ["doc_id", "text", "node", "spans", "kept"]
    return sorted(((r.doc_id, sum(s.b - s.a for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé €x") for _ in range(n))
    passages = [make(n) for n in (17, 20, 23, 31, 64)]
    rows = [(None, None), (1, ""), (2, "a" * 90), (3, "ab" * 50), (3, "ab" * 50), (None, passages[4])]
    for k in range(60):
        parts = [make(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                p = p[: rng.randint(1, len(p))] + make(1) + p[rng.randint(1, len(p)) :]
            parts += [p, make(rng.randint(0, 25))]
        rows.append((10 + k, "".join(parts)))
    rows += [(100 + k, rows[20][1]) for k in range(5)]
    return rows


@pytest.mark.parametrize(("seed", "threshold"), [(1, 16), (2, 20)])
def test_equals_brute_force(spark, seed, threshold):
    rows = corpus(seed)
    assert ours(spark, rows, threshold) == brute(rows, threshold)


def test_long_texts_in_segments(spark, monkeypatch):
    """Segments change the work, not the result; nothing in a batch is lost where texts are cut."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900_000))
    rows = [(1, base), (2, "xy" + base[300_000:700_000] + "z" * 600), (3, base[:500]), (4, "qq" + base[-450:] + "!" * 10)]
    assert ours(spark, rows, 400) == brute(rows, 400)


@pytest.mark.parametrize("chunk", [50, 3000])
def test_chunks_of_windows(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = corpus(7)
    assert ours(spark, rows, 16) == brute(rows, 16)


def test_empty_table(spark):
    assert ours(spark, [], 16) == []


def test_query_whole_table(spark):
    from conftest import DATA

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = suffix_dedup.op11_suffix_array_dedup(spark, DATA).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 400)
    assert sum(r.n_removed for r in found) > 0
