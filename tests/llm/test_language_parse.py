"""The parse side by side equals a greedy parse from the first byte on."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import language_id
from larder.llm.textbytes import column_bytes


def greedy(text: bytes, reference: bytes) -> int:
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in reference:
            k += 1
        n, i = n + 1, i + k
    return n


@pytest.mark.parametrize("segment", [3, 8, 64])
def test_phrases(monkeypatch, segment):
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    rng = random.Random(segment)
    words = ["".join(rng.choice("abé日 ") for _ in range(rng.randint(1, 6))) for _ in range(12)]
    fold = lambda t: bytes(language_id.fold(np.frombuffer(t.encode(), np.uint8)))
    learned = tuple((str(k), fold("".join(rng.choice(words[k * 4 :]) for _ in range(60)))) for k in range(3))
    texts = ["", "a", "z", "a" * 300, words[0] * 40, learned[0][1].decode("utf-8", "ignore"), *("".join(rng.choice([*words, "x"]) for _ in range(rng.randint(1, 80))) for _ in range(60))]
    got = language_id.phrases(*column_bytes(pa.array(texts)), learned)
    assert [[greedy(fold(t), ref) for t in texts] for _, ref in learned] == got.tolist()


def test_null_and_repeated_identifiers(spark):
    rows = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again").alias("text"), F.lit("en").alias("lang"))
    learned = language_id.references(rows, total=1 << 20)
    assert len(learned[0][1]) < language_id.REFERENCE_ROWS * 21 + 1
