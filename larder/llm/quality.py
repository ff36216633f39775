"""Quality classifier: hashed word and character n-gram vectors, averaged, with a softmax on top."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.shared import documents, table, unused
from larder.llm.textbytes import NOT_SPACE, Words, column_bytes, mix, slices

BUCKETS = 1 << 16
DIM = 16
GRAMS = (2, 3, 4)
SAMPLE_ROWS = 4000
"""The classifier is fitted on at most so many labelled rows,"""
SAMPLE_BYTES = 1 << 14
"""of at most so many bytes each; both bound what the driver holds."""
EPOCHS = 8
RATE = 0.6
THRESHOLD = 0.7


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 rows, and the row of each."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))
    if len(at) == len(data):
        return lead.astype(np.uint32), row
    more = (lead >= 0xC0).astype(np.uint8) + (lead >= 0xE0) + (lead >= 0xF0)
    points = (lead & np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint8)[more]).astype(np.uint32)
    for i in (1, 2, 3):
        longer = np.flatnonzero(more >= i)
        points[longer] = points[longer] << 6 | (data[at[longer] + i] & 0x3F)
    return points, row


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every feature: words, repeated words and character n-grams; texts that differ only in digits are one.

    A word that repeats the word before it counts as a feature of its own.
    """
    digits = (data >= 0x30) & (data <= 0x39)
    data = np.where(digits, np.uint8(0x30), data)
    words = Words(data, offsets, NOT_SPACE)
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    buckets, rows = [words.hashes % np.uint64(BUCKETS - 1) + np.uint64(1)], [row]
    again = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])) + 1
    buckets.append(np.zeros(len(again), np.uint64))
    rows.append(row[again])
    points, point_row = characters(data, offsets)
    for n in GRAMS:
        if len(points) >= n:
            gram = np.full(len(points) - n + 1, n, np.uint64)
            for i in range(n):
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - n + 1 + i]
            own = point_row[: len(gram)] == point_row[n - 1 :]
            buckets.append(mix(gram[own]) % np.uint64(BUCKETS - 1) + np.uint64(1))
            rows.append(point_row[: len(gram)][own])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(rows)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Vectors and softmax by stochastic gradient descent; returns what scoring needs.

    As the text's vector is the mean of its features' vectors, the margin of the
    two softmax outputs is the mean of one number for each bucket, plus the bias.
    Without rows of both labels, the margin is that of the label's share alone.
    """
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), bias
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    out, out_bias = np.zeros((2, DIM), np.float32), np.array([0.0, bias], np.float32)
    every, shares, ends = [], [], [0]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, counts = np.unique(features(data, np.array([0, len(data)]))[0], return_counts=True)
        every.append(ids.astype(np.uint16))  # BUCKETS fit
        shares.append((counts / max(1, counts.sum())).astype(np.float32))
        ends.append(ends[-1] + len(ids))
    every, shares = np.concatenate(every), np.concatenate(shares)
    steps, step = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            rate = RATE * (1 - step / steps)
            step += 1
            ids, parts = every[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]]
            if not len(ids):
                continue
            mean = parts @ vectors[ids]
            logits = out @ mean + out_bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            vectors[ids] -= np.outer(parts, (rate * 20) * (p @ out))
            out -= rate * np.outer(p, mean)
            out_bias -= rate * 0.1 * p
    return vectors @ (out[1] - out[0]), float(out_bias[1] - out_bias[0])


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The margin of label 1 for each row; a row without features has the bias."""
    buckets, row = features(data, offsets)
    n = len(offsets) - 1
    total = np.bincount(row, weights=weights[buckets].astype(np.float64), minlength=n)
    return total / np.maximum(np.bincount(row, minlength=n), 1) + bias


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``; a null identifier counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, quality of at most ``rows`` labelled rows that are not held out, by the order of a hash of their identifier."""
    chosen = labels.where((remainder("doc_id", 4) != 2) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    met = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality"))
    return met.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("text", "quality")


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text; a null text counts as empty."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers, whatever the input
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    whole = unused(docs, "whole_text")
    inner = docs.select(*kept, F.coalesce("text", F.lit("")).alias(whole))
    schema = docs.select(*kept).schema.add(column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, whole):
            data, offsets = column_bytes(part.column(whole))
            margin = margins(data, offsets, shared.value, bias)
            columns = [part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-margin)))], [*kept, column])

    return inner.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model from the bounded sample of labelled rows.

    One task fits it, so that the driver holds no texts: it gets the weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        weights, bias = fit([r["text"] for r in rows], [r["quality"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()]), pa.array([bias])], ["weights", "bias"])

    found = training_rows(docs, labels).coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    return fit([], []) if found is None else (np.frombuffer(found["weights"], np.float32), found["bias"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns only from labels of rows that are not held out (remainder 2 of 4), on
    at most SAMPLE_ROWS texts of at most SAMPLE_BYTES bytes. Scores see the text
    alone. A null or empty text has the score of the learned bias. Several labels
    of one identifier count as their largest; labels other than 0 and 1 are
    ignored. Without labels of both kinds every score is the share of label 1.
    Repeated rows get equal results; other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``."""
    column = unused(docs, "score")
    return score(docs, train(docs, labels), column).where(F.col(column) >= threshold).drop(column)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
