"""Frequent shingles: broadcast or joined, they give the same classes; and a hot group equals brute force."""

import math
import random
import re
from collections import Counter

from larder.llm import near_dedup


def classes(texts):
    sh = []
    for t in texts:
        w = re.findall(r"[0-9a-z]+", t)
        sh.append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))))
    df, n = Counter(s for c in sh for s in c), len(texts)
    weight = [{s: k * (1 + math.log((n + 1) / df[s]) / math.log(n + 1)) for s, k in c.items()} for c in sh]
    total = [sum(w.values()) for w in weight]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            both = sum(min(v, weight[b].get(s, 0)) for s, v in weight[a].items())
            if both / (total[a] + total[b] - both) >= 0.8:
                parent[find(a)] = find(b)
    return [min(i for i in range(n) if find(i) == find(x)) for x in range(n)]


def test_hot_group(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") + str(i) for i in range(90)]
    texts = []
    for _ in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(40))
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice("pqrs") + str(rng.randrange(99)) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    expected = classes(texts)
    assert 3 < len(set(expected)) < 199
    for often, most in ((16, 1 << 20), (2, 1 << 20), (2, 0)):
        monkeypatch.setattr(near_dedup, "OFTEN", often)
        monkeypatch.setattr(near_dedup, "OFTEN_BYTES", most)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
        assert [got[i] for i in range(len(texts))] == expected
