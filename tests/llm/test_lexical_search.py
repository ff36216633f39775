"""Ranked search against a direct scoring of every document, and the query against its SQL."""

import math
import random
import re
from collections import Counter

from larder.llm import lexical_search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs, queries):
    tokens = [(k, terms(t)) for k, t in docs]
    tokens = [(k, w) for k, w in tokens if w]
    n, total = len(tokens), sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    out = []
    for item, text in queries:
        found = []
        for k, w in tokens:
            tf, m = Counter(w), 25 + (75 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            if score > 0:
                found.append((-score, k is not None, k or 0, k))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:10])]
    return sorted(out, key=str)


def ours(spark, docs, queries):
    d = spark.createDataFrame([(k, t, "mine", 1) for k, t in docs], "doc_id long, text string, score string, n int")
    q = spark.createDataFrame([(k, t, 1) for k, t in queries], "item_id long, text string, rank int")
    found = lexical_search.search(d, q)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "x1", *[f"w{i}" for i in range(120)]]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([4, 20, 124])]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(None, text(9)), (900, None), (901, ""), (902, "?!"), (903, text(4000))]
    docs += [(1000 + k, docs[7][1] + " w1 w2 w3") for k in range(30)] + [docs[3], docs[3]]
    queries = [(k, text(rng.randint(1, 30))) for k in range(15)] + [(50, docs[7][1]), (51, None), (52, "..."), (53, "unheard words"), (54, "THE the The")]
    return docs, queries


def test_equals_brute_force(spark):
    docs, queries = corpus(3)
    assert ours(spark, docs, queries) == brute(docs, queries)


def test_small_pieces_and_blocks(spark, monkeypatch):
    """Neither the pieces of a task nor the blocks of queries nor the parts of a long text change the result."""
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 300)
    docs, queries = corpus(4)
    assert ours(spark, docs, queries) == brute(docs, queries)


def test_parts_of_long_texts():
    import numpy as np

    raw = b"word " * 500_000 + "éé".encode() * 700_000 + b" end"
    parts = list(lexical_search._parts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert b"".join(p.tobytes() for p, _ in parts) == raw and len(parts) > 2
    assert all(a[-1] == 0x20 or b[0] == 0x20 for (a, _), (b, _) in zip(parts, parts[1:], strict=False))


def test_empty_tables(spark):
    assert ours(spark, [], [(1, "a")]) == [] == ours(spark, [(1, "a")], [])


def test_query_matches_sql(same):
    same(lexical_search.op12_lexical_search, lexical_search.ORACLE_SQL["op12_lexical_search"])
