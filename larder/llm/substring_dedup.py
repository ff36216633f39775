"""Repeated passages: suffix automata of reference shards, matching statistics, removal of maximal spans.

An automaton of the whole corpus on every task would make the work grow with
the square of the corpus. So the references are dealt into shards that can be
matched apart: every window of the wanted length goes with its anchor, the least
hash among the short word runs in it. Equal windows have equal anchors, so each
anchor's stretches of text form a shard of their own. A shard of more than
SHARD_BYTES is dealt on by a further anchor, under another hash, and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.llm.shared import documents, settle, small
from larder.llm.textbytes import NOT_SPACE, Words, column_bytes, mix, run_starts, slices

LENGTH = 35
GRAM = 13
SHARD_BYTES = 1 << 18
"""An automaton holds at most so many bytes of text, unless it is of one window."""
LEVELS = 8
"""After so many anchors a shard is one window's."""
_U = np.uint64


class Automaton:
    """The suffix automaton of stretches of words, with how often each state's factors occur.

    ``times`` is how often each stretch stands in the corpus.
    """

    def __init__(self, stretches: list[list[bytes]], times: list[int]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for n, stretch in enumerate(stretches):
            last = 0
            for c in stretch:
                last = self._extend(last, c)
                self.count[last] += times[n]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _state(self, length: int, link: int, out: dict[bytes, int]) -> int:
        self.next.append(out)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, c: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: bytes) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[p] + 1 == self.length[q] else self._clone(p, c, q)
        return cur

    def repeated(self, stretch: list[bytes], width: int) -> list[int]:
        """Starts in ``stretch`` of the runs of ``width`` words that occur more than once."""
        state, found = 0, []
        for i, c in enumerate(stretch):
            state = self.next[state][c]  # every stretch is in the automaton: the match never breaks
            if i + 1 >= width:
                while self.length[self.link[state]] >= width:
                    state = self.link[state]
                if self.count[state] > 1:
                    found.append(i + 1 - width)
        return found


def anchors(words: Words, width: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """(anchor, row, first window's start in the row, windows) of each stretch of windows that share an anchor.

    The anchor of a window is the least hash of its runs of GRAM words, the
    leftmost if it stands more than once. Each level has hashes of its own; from
    LEVELS on, a window's anchor is the hash of all its words.
    """
    run = min(GRAM, width) if level < LEVELS else width
    gram, counts = words.windows(run)[0], words.counts
    if level:
        gram = mix(gram + _U(level))
    per = width - run + 1
    n_windows = np.maximum(counts - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), n_windows)
    if not len(row):
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, none
    local = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    n_grams = np.maximum(counts - run + 1, 0)
    base = (np.cumsum(n_grams) - n_grams)[row] + local
    # Position of the least of `per` neighbours, by doubling: least[i] covers span grams from i on.
    least, span = np.arange(len(gram)), 1
    while span < per:
        step = min(span, per - span)
        other = least[np.minimum(np.arange(len(gram)) + step, len(gram) - 1)]
        least = np.where(gram[other] < gram[least], other, least)
        span += step
    at = least[base]
    begin = run_starts(at)
    size = np.diff(np.r_[begin, len(at)])
    return gram[at[begin]], row[begin], local[begin], size


class Passages:
    """The rows of a slice as words joined by one space each, to cut stretches from."""

    def __init__(self, column: pa.Array):
        data, offsets = column_bytes(column)
        self.words = Words(data, offsets, NOT_SPACE)
        size = self.words.ends - self.words.starts + 1
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        plain = np.full(int(self.ends[-1]) if len(size) else 0, 0x20, np.uint8)
        inside = np.ones(len(plain), bool)
        inside[self.ends - 1] = False
        plain[inside] = data[NOT_SPACE[data]]
        self.plain = plain.tobytes()

    def cut(self, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The ``size`` words from word ``start`` of each row."""
        at = self.words.first[row] + start
        return [self.plain[a : b - 1] for a, b in zip(self.starts[at].tolist(), self.ends[at + size - 1].tolist(), strict=True)]


def _same(stretches: list[bytes]) -> pa.Array:
    """128 bits of a cryptographic hash of each stretch."""
    return pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in stretches], pa.binary())


def _stretches(width: int):
    """Rows of every stretch of a document: doc_id, h, anchor, start, n, same (hash of its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = Passages(part.column("text"))
            anchor, row, start, n = anchors(text.words, width)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(at), part.column("h").take(at), pa.array(anchor.view(np.int64)), pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)), _same(text.cut(row, start, n + width - 1)),
                ],
                ["doc_id", "h", "anchor", "start", "n", "same"],
            )

    return run


def _cut(width: int):
    """The words of the wanted stretches (text, wanted): anchor, same, times, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = Passages(part.column("text"))
            wanted = part.column("wanted")
            flat = wanted.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(wanted.offsets)))
            start, n = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "n"))
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor"), flat.field("same"), flat.field("times"), pa.array(text.cut(row, start, n + width - 1), pa.binary())],
                ["anchor", "same", "times", "words"],
            )

    return run


def _deal(width: int, level: int):
    """The stretches of large shards by their next anchor: anchor, same, whole_anchor, whole_same, at (first window), times, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "words"):
            text = Passages(part.column("words"))
            anchor, row, start, n = anchors(text.words, width, level)
            whole = part.column("anchor").to_numpy().view(_U)
            cut, at = text.cut(row, start, n + width - 1), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix(anchor + mix(whole[row])).view(np.int64)), _same(cut), part.column("anchor").take(at), part.column("same").take(at),
                    pa.array(start.astype(np.int32)), part.column("times").take(at), pa.array(cut, pa.binary()),
                ],
                ["anchor", "same", "whole_anchor", "whole_same", "at", "times", "words"],
            )

    return run


def _match(width: int):
    """Matching statistics of every shard's stretches over the shard's automaton: anchor, same, starts."""

    def shard(rows: list[tuple[int, bytes, int, bytes]]) -> list[tuple[int, bytes, list[int]]]:
        stretches = [r[3].split(b" ") for r in rows]
        automaton = Automaton(stretches, [r[2] for r in rows])
        return [(r[0], r[1], automaton.repeated(s, width)) for r, s in zip(rows, stretches, strict=True)]

    def out(found: list[tuple[int, bytes, list[int]]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["anchor", "same", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, int, bytes]] = []
        for batch in batches:
            found: list[tuple[int, bytes, list[int]]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    found += shard(rows)
                    rows = []
                rows.append(row)
            yield out(found)
        if rows:
            yield out(shard(rows))

    return run


_STARTS = "anchor long, same binary, starts array<int>"


def repeated_starts(kinds: DataFrame, width: int, level: int = 1) -> DataFrame:
    """anchor, same, starts: the windows of each stretch that occur more than once among those of its anchor.

    ``kinds``: anchor, same, times, words - each different stretch of an anchor
    once, with how often it stands in the corpus. Anchors with more text than
    SHARD_BYTES are dealt on: their stretches are cut where the next anchor
    changes, equal pieces counted together, and the results carried back.
    """
    held = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes"))
    large = settle(held.where((F.col("n") > 1) & (F.col("bytes") > SHARD_BYTES)).select("anchor"), "large-shards")
    few = kinds.join(small(large), "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    starts = few.select("anchor", "same", "times", "words").mapInArrow(_match(width), _STARTS).where(F.size("starts") > 0)
    if not large.limit(1).count():
        return settle(starts, "repeated-starts")
    dealt = "anchor long, same binary, whole_anchor long, whole_same binary, at int, times long, words binary"
    parts = settle(kinds.join(small(large), "anchor", "left_semi").select("anchor", "same", "times", "words").mapInArrow(_deal(width, level), dealt), "dealt-stretches")
    deeper = parts.groupBy("anchor", "same").agg(F.sum("times").alias("times"), F.min("words").alias("words"))
    found = repeated_starts(settle(deeper, "kinds"), width, level + 1)
    back = parts.join(found, ["anchor", "same"]).select("whole_anchor", "whole_same", F.transform("starts", lambda x: x + F.col("at")).alias("starts"))
    back = back.groupBy("whole_anchor", "whole_same").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return settle(starts.unionByName(back.select(F.col("whole_anchor").alias("anchor"), F.col("whole_same").alias("same"), "starts")), "repeated-starts")


def repeated_windows(docs: DataFrame, width: int = LENGTH) -> DataFrame:
    """doc_id, h, start, n: the stretches of window starts whose windows occur more than once.

    ``docs``: doc_id, h, text, one row for each text.
    """
    key = docs.select("doc_id", "h").schema
    found = docs.mapInArrow(_stretches(width), StructType([*key.fields]).add("anchor", "long").add("start", "integer").add("n", "integer").add("same", "binary"))
    # Counts combine before the shuffle, and the join back deals a passage of many documents to several tasks.
    several = found.groupBy("anchor").agg(F.count("*").alias("total"), F.min("same").alias("lo"), F.max("same").alias("hi")).where("total > 1")
    several = small(settle(several.select("anchor", (F.col("lo") == F.col("hi")).alias("alike")), "shared-anchors"))
    shared = settle(found.join(several, "anchor"), "shared-stretches")
    alike = shared.where("alike").select("doc_id", "h", "start", "n")
    mixed = shared.where("not alike")
    kinds = mixed.groupBy("anchor", "same").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "h", "start", "n")).alias("at")
    )
    wanted = settle(kinds, "kinds").select("at.*", "anchor", "same", "times").groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("anchor", "same", "times", "start", "n")).alias("wanted")
    )
    wanted = settle(wanted, "wanted")
    texts = _met(_with(docs, small(wanted.select("doc_id", "h")), "left_semi").dropDuplicates(["doc_id", "h"]), wanted).select("d.text", "s.wanted")
    cut = settle(texts.mapInArrow(_cut(width), "anchor long, same binary, times long, words binary"), "stretch-words")
    starts = repeated_starts(cut, width)
    runs = mixed.join(starts, ["anchor", "same"]).select("doc_id", "h", F.explode(F.transform("starts", lambda x: x + F.col("start"))).alias("start"), F.lit(1).alias("n"))
    return alike.unionByName(runs)


def _met(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Rows d of the documents with their row s of ``found``; null identifiers meet."""
    return docs.alias("d").join(found.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.h") == F.col("s.h")), how)


def _with(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return _met(docs, keys, how).select("d.*")


def maximal_spans(found: DataFrame, width: int) -> DataFrame:
    """doc_id, h, spans: the words [start, end) that the windows of each text cover, as few runs as possible."""
    order = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    words = found.select("doc_id", "h", "start", (F.col("start") + F.col("n") + width - 1).alias("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = words.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    runs = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, width: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the remaining text), spans (removed runs of words).

    Words: runs of characters other than ASCII white space, unchanged. A window
    of ``width`` words is removed wherever it stands if its words start at any
    other place too, in the same or another row; what is left plays no part. A
    null text has no words. Rows that repeat an identifier and its text are
    copies of each other; identifiers may be of any type that sorts. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    ``kept`` joins the words left by one space.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = repeated_windows(rows, width)
    spans = settle(maximal_spans(found, width), "spans")
    met = _met(rows, small(spans), "left").select("d.doc_id", "d.text", F.coalesce("s.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    kept = StructType([rows.schema["doc_id"]]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return met.mapInArrow(_remove, kept.add("spans", met.schema["spans"].dataType))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the spans out of the texts."""
    for part in slices(batches):
        data, offsets = column_bytes(part.column("text"))
        words = Words(data, offsets, NOT_SPACE)
        spans = part.column("spans")
        flat, row = spans.flatten(), np.repeat(np.arange(part.num_rows), np.diff(np.asarray(spans.offsets)))
        edge = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(edge, words.first[row] + np.asarray(flat.field("start")), 1)
        np.add.at(edge, words.first[row] + np.asarray(flat.field("end")), -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw, kept, removed = data.tobytes(), [], []
        begin, end = words.starts.tolist(), words.ends.tolist()
        for r in range(part.num_rows):
            a, b = words.first[r], words.first[r + 1]
            left = (np.flatnonzero(~gone[a:b]) + a).tolist()
            kept.append(b" ".join([raw[begin[i] : end[i]] for i in left]).decode("utf-8", "replace"))
            removed.append(int(b - a) - len(left))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), spans],
            ["doc_id", "n_words", "n_removed", "kept", "spans"],
        )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE_SQL = {
    "op6_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (h)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
  FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
}
