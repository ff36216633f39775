"""Ranked lexical search: impact vectors in order of length, pruned as a maximum inner product search.

A document's vector has one impact for each query term, times the square root of
the term's weight, and a query's the same root times its count, so that their
inner product is the score. Buckets of documents of nearly equal length are
skipped where length times length (Cauchy-Schwarz) stays below the query's tenth
best score so far. Inside a bucket, a query's heaviest coordinates bound each
document, and only survivors are scored, in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from larder.llm.decontaminate import WORD, words
from larder.llm.shared import documents, settle, table
from larder.llm.textbytes import LOWER_WORD, Words, column_bytes, run_starts, slices

TOP = 10
RATIO = 0.9
"""A bucket's shortest vector is at least so long as this share of its longest."""
QUERY_BYTES = 4 << 20
"""Queries are taken in blocks of about so many bytes of text; each block reads the corpus's term vectors once."""
AHEAD = 1 / 32
"""This share of the documents, those of the longest vectors, is searched first and gives the others their thresholds."""
PIECE = 1 << 20
"""About how many postings a task orders by length at a time."""
LONG = 1 << 20
"""Longer texts are counted in parts, cut between words."""
_WIDER = 1 + 1e-9
"""Bounds in floating point are widened by this factor."""
_U = np.uint64


class Vocabulary:
    """The terms of a block of queries, by hash; a word is one of them only if its bytes are equal too."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.cumsum([0, *map(len, raw)])
        h = Words(data, offsets, np.ones(256, bool)).hashes
        order = np.argsort(h)
        self.hashes, self.ids, self.sizes = h[order], order, np.diff(offsets)[order]
        self.data, self.starts = data, offsets[:-1][order]

    def find(self, data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place among the words, id) of the words that are terms."""
        if not len(self.hashes) or not len(found.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, found.hashes), len(self.hashes) - 1)
        size = found.ends - found.starts
        hit = np.flatnonzero((self.hashes[at] == found.hashes) & (self.sizes[at] == size))
        at, size, start = at[hit], size[hit], found.starts[hit]
        same = np.ones(len(hit), bool)
        for i in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > i)
            same[live] &= data[start[live] + i] == self.data[self.starts[at[live]] + i]
        return hit[same], self.ids[at[same]]


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of a slice; of one long text several, cut behind bytes that are no part of a word."""
    if len(data) <= LONG:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        to = min(at + LONG, len(data))
        while to < len(data):
            gap = np.flatnonzero(~LOWER_WORD[data[to : to + LONG]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + LONG, len(data))
        yield data[at:to], np.array([0, to - at])
        at = to


def term_vectors(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """doc_id, n (all terms of the text), ids, tf (those in the vocabulary) of each row that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        v = max(len(known.terms), 1)
        for part in slices(batches):
            data, offsets = column_bytes(part.column("text"))
            data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
            n, keys, times = np.zeros(part.num_rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for some, ends in _parts(data, offsets):
                found = Words(some, ends, LOWER_WORD)
                n += found.counts if len(found.counts) == part.num_rows else found.counts.sum()
                at, ids = known.find(some, found)
                key, count = np.unique((np.searchsorted(found.first, at, "right") - 1) * v + ids, return_counts=True)
                keys.append(key), times.append(count)
            keys, times = np.concatenate(keys), np.concatenate(times)
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
            first = run_starts(keys)
            times = np.add.reduceat(times, first) if len(first) else times
            row, ids = keys[first] // v, keys[first] % v
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=part.num_rows))].astype(np.int32))
            some = pa.array(np.flatnonzero(n))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))).take(some) for x in (ids, times)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(some), pa.array(n).take(some), *lists], ["doc_id", "n", "ids", "tf"])

    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    schema = StructType([texts.schema["doc_id"]])
    return texts.mapInArrow(run, schema.add("n", LongType()).add("ids", ArrayType(IntegerType())).add("tf", ArrayType(IntegerType())))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Search:
    """What a task needs: the queries' counts and weights by term, and the corpus's numbers."""

    def __init__(self, queries: list[dict[int, int]], weights: list[int], n_docs: int, n_terms: int):
        self.w = np.array(weights, np.int64)
        self.root = np.sqrt(self.w.astype(float))
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids, self.counts, self.rest, self.lengths = [], [], [], []
        for q in queries:
            ids = np.array(sorted((i for i in q if self.w[i] > 0), key=lambda i: (-q[i] * self.root[i], i)), np.int64)
            counts = np.array([q[i] for i in ids.tolist()], np.int64)
            squares = (counts * self.root[ids]) ** 2
            rest = np.sqrt(np.r_[np.cumsum(squares[::-1])[::-1], 0.0])
            self.ids.append(ids), self.counts.append(counts), self.rest.append(rest), self.lengths.append(rest[0])
        self.lengths = np.array(self.lengths, float)

    def impacts(self, n: np.ndarray, row: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.n_docs) // max(self.n_terms, 1)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])

    def best(self, batches: Iterator[pa.RecordBatch], floor: np.ndarray, least: int, most: int) -> Iterator[tuple]:
        """(query, doc_id, score) of the best documents of the batches with buckets from ``least`` to ``most``, TOP a query."""
        heaps: list[list] = [[] for _ in self.ids]
        floor = floor.copy()
        for batch in _pieces(batches):
            self._piece(batch, floor, least, most, heaps)
        for q, heap in enumerate(heaps):
            for score, _, key in heap:
                yield q, key, -score

    def measure(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(row, id, impact, scaled impact, length of each row, its bucket)."""
        lists = batch.column("ids")
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        ids, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
        impact = self.impacts(batch.column("n").to_numpy(), row, tf)
        scaled = impact * self.root[ids] if len(ids) else impact.astype(float)
        length = np.sqrt(np.bincount(row, scaled * scaled, batch.num_rows))
        bucket = np.where(length > 0, np.floor(np.log(np.maximum(length, 1e-9)) / -math.log(RATIO)), -1).astype(np.int64)
        return row, ids, impact, scaled, length, bucket

    def _piece(self, batch: pa.RecordBatch, floor: np.ndarray, least: int, most: int, heaps: list[list]) -> None:
        row, ids, impact, scaled, length, bucket = self.measure(batch)
        wanted = (bucket >= least) & (bucket <= most)
        for b in np.unique(bucket[wanted])[::-1].tolist():
            docs = np.flatnonzero(wanted & (bucket == b))
            longest = length[docs].max() * _WIDER
            open_ = np.flatnonzero((self.lengths > 0) & (longest * self.lengths * _WIDER >= floor))
            if not len(open_):
                continue
            place = np.full(len(length), -1)
            place[docs] = np.arange(len(docs))
            own = np.flatnonzero(place[row] >= 0)
            bundle = _Bucket(place[row[own]], ids[own], impact[own], scaled[own], length[docs], len(self.w))
            for q in open_.tolist():
                some, score = bundle.survivors(self, q, floor[q], longest)
                if not len(some):
                    continue
                keys = batch.column("doc_id").take(pa.array(docs[some])).to_pylist()
                both = heaps[q] + [(-s, (k is not None, k if k is not None else 0), k) for s, k in zip(score.tolist(), keys, strict=True)]
                heaps[q] = sorted(both, key=lambda x: x[:2])[:TOP]
                if len(heaps[q]) == TOP:
                    floor[q] = max(floor[q], -heaps[q][-1][0])


class _Bucket:
    """The postings of documents of nearly equal length, by document and by term."""

    def __init__(self, doc: np.ndarray, ids: np.ndarray, impact: np.ndarray, scaled: np.ndarray, length: np.ndarray, n_terms: int):
        self.doc_ids, self.doc_impact, self.length = ids, impact, length
        self.doc_first = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(length)))]
        order = np.argsort(ids, kind="stable")
        self.doc, self.scaled = doc[order], scaled[order]
        self.first = np.searchsorted(ids[order], np.arange(n_terms + 1))

    def survivors(self, search: Search, q: int, floor: float, longest: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of those that may be among the best of a query whose tenth best score is ``floor``."""
        ids, counts, rest = search.ids[q], search.counts[q], search.rest[q]
        # so many coordinates, heaviest first, that a document with none of them cannot reach the floor
        focus = int(np.searchsorted(-rest * longest * _WIDER, -floor, "right")) if floor > 0 else len(ids)
        focus = max(1, min(len(ids), focus + 2))
        near, seen = np.zeros(len(self.length)), np.zeros(len(self.length))
        for i in range(focus):
            a, b = self.first[ids[i]], self.first[ids[i] + 1]
            x = self.scaled[a:b]
            near[self.doc[a:b]] += x * (counts[i] * search.root[ids[i]])
            seen[self.doc[a:b]] += x * x
        left = np.sqrt(np.maximum(self.length**2 * _WIDER - seen, 0))
        some = np.flatnonzero((near + rest[focus] * left) * _WIDER >= max(floor, 1e-9))
        if not len(some):
            return some, some
        size = np.diff(self.doc_first)[some]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.doc_first[some], size)
        value = np.zeros(len(search.w), np.int64)
        value[ids] = counts * search.w[ids]
        each = value[self.doc_ids[at]] * self.doc_impact[at]
        begin = np.cumsum(size) - size
        score = np.zeros(len(some), np.int64)
        filled = size > 0
        score[filled] = np.add.reduceat(each, begin[filled]) if filled.any() else 0
        good = (score > 0) & (score >= floor)
        return some[good], score[good]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, joined while they have fewer than PIECE postings."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("ids").flatten())
        if size >= PIECE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lengths(vectors: DataFrame, search: Broadcast) -> dict[int, int]:
    """How many documents each bucket of lengths has; a few hundred buckets whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(search.value.measure(batch)[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["bucket", "n"])

    rows = vectors.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r["bucket"]: r["n"] for r in rows if r["bucket"] >= 0}


def _best(vectors: DataFrame, search: Broadcast, floor: Broadcast, least: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(search.value.best(batches, floor.value, least, most))
        q, doc, score = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], ["q", "doc_id", "score"])

    kind = to_arrow_type(vectors.schema["doc_id"].dataType)
    return vectors.select("doc_id", "n", "ids", "tf").mapInArrow(run, StructType([StructField("q", LongType())]).add("doc_id", vectors.schema["doc_id"].dataType).add("score", LongType()))


def _top(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block(docs: DataFrame, items: list, texts: list[list[str]]) -> DataFrame:
    """q, doc_id, score, rank of one block of queries (their terms in ``texts``)."""
    sc = docs.sparkSession.sparkContext
    known = Vocabulary(sorted({t for x in texts for t in x}))
    number = {t: i for i, t in enumerate(known.terms)}
    queries = [{} for _ in items]
    for q, x in zip(queries, texts, strict=True):
        for t in x:
            q[number[t]] = q.get(number[t], 0) + 1
    vectors = settle(term_vectors(docs, sc.broadcast(known)), "term-vectors")
    whole = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    df = {r["id"]: r["n"] for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect()}
    search = sc.broadcast(Search(queries, [weight(whole["n"], df.get(i, 0)) for i in range(len(known.terms))], whole["n"], whole["terms"] or 0))
    sizes = _lengths(vectors, search)
    cut, taken = 0, 0
    for b in sorted(sizes, reverse=True):
        cut, taken = b, taken + sizes[b]
        if taken >= AHEAD * whole["n"]:
            break
    none = np.zeros(len(items))
    ahead = settle(_top(_best(vectors, search, sc.broadcast(none), cut, 1 << 40), TOP), "first-matches")
    floor = none.copy()
    for r in ahead.where(F.col("rank") == TOP).select("q", "score").collect():
        floor[r["q"]] = r["score"]
    rest = _best(vectors, search, sc.broadcast(floor), 0, cut - 1)
    return _top(ahead.drop("rank").unionByName(rest), TOP)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the TOP documents of ``docs`` (doc_id, text) for each of ``queries`` (``id_col``, text).

    Terms are lower-cased (A-Z only) runs of ASCII letters and digits and
    everything beyond ASCII; repeats in a query count. Only scores above 0 are
    returned; of equal ones the smaller doc_id comes first (nulls first of all).
    Null or empty texts have no terms, as documents (they do not count) and as
    queries (they get no rows). Rows that repeat a document rank each for
    themselves; queries that repeat an id and text are one, those of one id and
    different texts are ranked apart. Very long texts are counted in parts; empty
    tables give no rows; other columns are ignored.

    Queries come to the driver in blocks of about QUERY_BYTES, never whole.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(id_col).alias("item_id"), words(F.coalesce("text", F.lit(""))).alias("terms")).where(F.size("terms") > 0).distinct()
    asked = settle(asked.withColumn("bytes", F.octet_length(F.array_join("terms", " "))), "queries")
    total = asked.agg(F.sum("bytes")).first()[0] or 0
    blocks = -(-total // QUERY_BYTES) or 1
    key = F.pmod(F.xxhash64("item_id", F.array_join("terms", " ")), F.lit(blocks))
    out = spark.createDataFrame([], StructType([queries.schema[id_col]]).add("rank", IntegerType()).add("doc_id", docs.schema["doc_id"].dataType).add("score", LongType()))
    out = out.withColumnRenamed(id_col, "item_id") if id_col != "item_id" else out
    for block in range(blocks if total else 0):
        rows = asked.where(key == block).select("item_id", "terms").toArrow()
        items = rows.column("item_id").to_pylist()
        found = _block(docs, items, rows.column("terms").to_pylist())
        named = spark.createDataFrame(list(enumerate(items)), StructType([StructField("q", LongType())]).add("item_id", queries.schema[id_col].dataType))
        out = out.unionByName(found.join(F.broadcast(named), "q").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical_search": op12_lexical_search}
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
ORACLE_SQL = {
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY 1, 2),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 100 - 75 + ((75 * len(w) * n_docs) // n_terms) AS m FROM d, corpus WHERE len(w) > 0),
df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, corpus),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN weighed USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
}
