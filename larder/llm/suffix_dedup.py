"""Removal of repeated byte passages by distributed prefix doubling over sampled suffixes.

Sorting every suffix of a corpus costs more than the corpus. Every window of
``threshold`` bytes therefore picks one position inside itself, the leftmost of
the least-hashed grams among its first bytes (its anchor), so equal windows pick
alike and only the suffixes at anchors are sorted. Spark ranks the anchors by
their first symbol, then by pairs of ranks at growing offsets, and drops those
that become unique. What is left shares a core of three quarters of the
threshold; the rest of the threshold is compared by digests of whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.shared import documents, partitions, settle, small, unused
from larder.llm.textbytes import column_bytes, mix, powers, run_starts, slices

THRESHOLD = 400
SEGMENT = 1 << 18
"""A longer text is read in segments of so many window starts; a window may reach into the next one."""
CHUNK = 1 << 18
"""Windows of so many starts are compared in a task before they are dealt out."""
_BASE = 0x9E3779B97F4A7C15 - 2
_PLACE = (1 << 20) - 1
"""Bits of an anchor's key that hold its place in a segment."""
_U = np.uint64


def sizes(threshold: int) -> tuple[int, int]:
    """(symbol, reach): an anchor's core is four symbols, and stands at most ``reach`` bytes after its window's start."""
    symbol = max(1, threshold * 3 // 16)
    return symbol, threshold - 4 * symbol


def _sums(data: np.ndarray) -> np.ndarray:
    ups, _ = powers(_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(mix(data.astype(_U) + _U(1)) * ups[: len(data)], out=sums[1:])
    return sums


def _grams(sums: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each place on."""
    _, downs = powers(_BASE, len(sums))
    at = np.arange(len(sums) - size) if isinstance(at, slice) else at
    return mix((sums[at + size] - sums[at]) * downs[at])


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(place, lo, hi, sums): the anchors of the windows that start in the ranges [first, last); each serves the starts lo to hi."""
    symbol, reach = sizes(threshold)
    sums = _sums(data)
    none = np.zeros(0, np.int64)
    starts = np.concatenate([none, *(np.arange(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True))])
    if not len(starts):
        return none, none, none, sums
    h = _grams(sums, slice(None), symbol)
    least = (h & ~_U(_PLACE)) | np.arange(len(h), dtype=_U)
    span = 1
    while span * 2 <= reach + 1:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if rest := reach + 1 - span:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least[starts] & _U(_PLACE)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)])
    return at[begin], starts[begin], starts[np.r_[begin[1:] - 1, len(starts) - 1]], sums


def _segments(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[tuple]:
    """(bytes, row of each range, its first start, its last start + 1, bytes ahead in the text, rows) of the texts, cut where they are long."""
    for part in slices(batches):
        data, offsets = column_bytes(part.column("text"))
        if len(data) <= SEGMENT * 2:
            ends = np.maximum(offsets[1:] - threshold + 1, offsets[:-1])
            yield data, np.arange(part.num_rows), offsets[:-1], ends, offsets[:-1], part
            continue
        for row in range(part.num_rows):
            a, b = int(offsets[row]), int(offsets[row + 1])
            for at in range(a, max(b - threshold + 1, a), SEGMENT):
                many = min(SEGMENT, b - threshold + 1 - at)
                yield data[at : min(at + SEGMENT + threshold, b)], np.array([row]), np.array([0]), np.array([many]), np.array([a - at]), part


def _finish(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names)


def _first_symbols(texts: DataFrame, threshold: int) -> DataFrame:
    """h, copies: the first symbol of each anchor, those of a segment counted once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, row, first, last, _, part in _segments(batches, threshold):
            at, lo, _, sums = anchors(data, first, last, threshold)
            whose = row[np.searchsorted(first, lo, "right") - 1]
            h = _grams(sums, at, sizes(threshold)[0])
            order = np.argsort(h)
            h, n = h[order], part.column("copies").to_numpy()[whose[order]]
            begin = run_starts(h)
            yield _finish([h[begin].view(np.int64), np.add.reduceat(n, begin) if len(begin) else n], ["h", "copies"])

    return texts.select("text", "copies").mapInArrow(run, "h long, copies long")


def _contexts(texts: DataFrame, threshold: int) -> DataFrame:
    """node, copies, lo, hi, h, h1, h2, h3, whole of each anchor: the four symbols of its core, and a digest of all that its windows span."""
    symbol, _ = sizes(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, row, first, last, ahead, part in _segments(batches, threshold):
            at, lo, hi, sums = anchors(data, first, last, threshold)
            k = np.searchsorted(first, lo, "right") - 1
            whose, base = pa.array(row[k]), ahead[k]
            raw = data.tobytes()
            whole = [
                hashlib.blake2b(raw[a : b + threshold] + b"%d,%d" % (p - a, b - a), digest_size=16).digest()
                for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)
            ]
            symbols = [_grams(sums, at + i * symbol, symbol).view(np.int64) for i in range(4)]
            yield _finish(
                [part.column("node").take(whose), part.column("copies").take(whose), lo - base, hi - base, *symbols, pa.array(whole, pa.binary())],
                ["node", "copies", "lo", "hi", "h", "h1", "h2", "h3", "whole"],
            )

    return texts.select("node", "text", "copies").mapInArrow(run, "node binary, copies long, lo long, hi long, h long, h1 long, h2 long, h3 long, whole binary")


def ranks(pairs: DataFrame, name: str) -> DataFrame:
    """a, b, n, rank of the distinct pairs of ``pairs`` (a, b, n), n summed; sorted by a range partitioning, ranks in that order."""
    distinct = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return settle(distinct.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()), name)


def double(suffixes: DataFrame, name: str) -> DataFrame:
    """``suffixes`` (whole, n, r0, r1, ...: ranks at offsets 0, k, 2k, ...) with half as many ranks, each of a pair; rows that are unique go.

    A rank at offset 0 carries how many suffixes have it; pairs further on are
    ranked with them, as the same text may stand at either place.
    """
    have = [c for c in suffixes.columns if c[0] == "r"]
    pairs = [(have[i], have[i + 1]) for i in range(0, len(have), 2)]
    every = None
    for i, (a, b) in enumerate(pairs):
        some = suffixes.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col("n") if i == 0 else F.lit(0).cast("long")).alias("n"))
        every = some if every is None else every.unionByName(some)
    ranked = ranks(every, f"ranks-{name}")
    out = suffixes
    for i, (a, b) in enumerate(pairs):
        own = ranked.where(F.col("n") > 1) if i == 0 else ranked
        own = own.select(F.col("a").alias(a), F.col("b").alias(b), F.col("rank").alias(f"s{i}"))
        out = out.join(own, [a, b])
    return settle(out.select("whole", "n", *[F.col(f"s{i}").alias(f"r{i}") for i in range(len(pairs))]), f"suffixes-{name}")


_WINDOW = "d1 long, d2 long, n1 long, n2 long, start long, sure boolean"


def _windows(texts: DataFrame, threshold: int) -> DataFrame:
    """Rows of each window of the anchors in ``at`` (an array of lo, hi, lone) of the rows of node, text, at.

    d1 and d2 are the window's digest, n1 and n2 the node (null where nobody asks:
    the anchor is not ``lone``, so its windows only answer). Windows that meet in a
    chunk are ``sure``; their rows are dealt by their place, and one more row
    stands for them, so that a frequent window is not dealt once for each text.
    """

    def flush(held: list[tuple]) -> pa.RecordBatch:
        d = np.frombuffer(b"".join(x[0] for x in held), np.int64).reshape(-1, 2)
        start, lone = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        node = np.repeat(np.frombuffer(b"".join(x[1] for x in held), np.int64).reshape(-1, 2), [len(x[2]) for x in held], axis=0)
        order = np.lexsort((d[:, 1], d[:, 0]))
        d, start, lone, node = d[order], start[order], lone[order], node[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]).any(1)])
        many = np.diff(np.r_[first, len(d)]) > 1
        sure = np.repeat(many, np.diff(np.r_[first, len(d)]))
        spread = mix(node.view(_U) + mix(start.astype(_U))[:, None]).view(np.int64)
        own, mark = np.flatnonzero(lone | ~sure), first[many]
        every = np.r_[own, mark]
        digests = np.concatenate([np.where(sure[own, None], spread[own], d[own]), d[mark]])
        asks = np.r_[lone[own], np.zeros(len(mark), bool)]
        columns = [pa.array(np.ascontiguousarray(digests[:, i])) for i in range(2)] + [pa.array(np.ascontiguousarray(node[every, i]), mask=~asks) for i in range(2)]
        columns += [pa.array(start[every]), pa.array(asks & sure[every])]
        return pa.RecordBatch.from_arrays(columns, ["d1", "d2", "n1", "n2", "start", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            node, text, spans = part.column("node").to_pylist(), part.column("text"), part.column("at")
            for i in range(part.num_rows):
                raw, lists = memoryview(text[i].as_buffer()), spans[i].values
                for at in range(0, len(lists), 1024):
                    some = lists.slice(at, 1024)
                    lo, hi = some.field("lo").to_numpy(), some.field("hi").to_numpy()
                    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                    digests = b"".join([hashlib.blake2b(raw[a : a + threshold], digest_size=16).digest() for a in starts.tolist()])
                    held.append((digests, node[i], starts, np.repeat(some.field("lone").to_numpy(zero_copy_only=False), hi - lo + 1)))
                    size += len(starts)
                    if size >= CHUNK:
                        yield flush(held)
                        held, size = [], 0
        if size:
            yield flush(held)

    return texts.mapInArrow(run, _WINDOW)


def _again(windows: DataFrame) -> DataFrame:
    """node, start of the windows asked for that stand again; rows of equal digests meet as neighbours of a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = None, False  # the last row so far, and whether it equals the one before it

        def out(rows: pa.Table, good: np.ndarray) -> pa.RecordBatch:
            rows = rows.filter(pa.array(good)).combine_chunks()
            node = np.stack([rows.column(c).to_numpy() for c in ("n1", "n2")], axis=1) if rows.num_rows else np.zeros((0, 2), np.int64)
            return _finish([pa.array([x.tobytes() for x in node], pa.binary()), rows.column("start").to_numpy()], ["node", "start"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            d = np.stack([rows.column(c).to_numpy() for c in ("d1", "d2")], axis=1)
            same = (d[1:] == d[:-1]).all(1)
            before = np.r_[met, same]
            good = (before | np.r_[same, False] | rows.column("sure").to_numpy()) & rows.column("n1").is_valid().to_numpy()
            yield out(rows.slice(0, rows.num_rows - 1), good[:-1])
            held, met = rows.slice(rows.num_rows - 1).combine_chunks(), bool(before[-1])
        if held is not None:
            yield out(held, np.array([(met or held.column("sure")[0].as_py()) and held.column("n1")[0].is_valid]))

    dealt = windows.repartition(partitions(windows.sparkSession), "d1", "d2").sortWithinPartitions("d1", "d2")
    return dealt.mapInArrow(run, "node binary, start long")


def _spans(found: DataFrame) -> DataFrame:
    """node, spans (array of a, b; maximal, ordered) of the rows node, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for each in batch.column("of"):
                a, b = each.values.field("a").to_numpy(), each.values.field("b").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                begin = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                out.append([{"a": x, "b": y} for x, y in zip(a[begin].tolist(), b[np.r_[begin[1:] - 1, len(b) - 1]].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, kind)], ["node", "spans"])

    lists = found.groupBy("node").agg(F.collect_set(F.struct("a", "b")).alias("of"))
    return lists.mapInArrow(run, "node binary, spans array<struct<a:long,b:long>>")


def _node(text: Column) -> Column:
    """128 bits of the SHA-256 of a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """node, spans of the texts of ``docs`` that hold repeated passages; ``node`` is ``_node`` of the text.

    ``spans`` (array of a, b; in bytes, b exclusive) are the maximal runs of bytes
    that a string of ``threshold`` bytes covers which starts anywhere else too.
    Equal texts are one node with a number of copies, so each of them counts
    where its suffixes are ranked, and none is compared with another.
    """
    rows = docs.select(_node(F.col(text_col)).alias("node"), F.col(text_col).alias("text")).where(F.octet_length("text") >= threshold)
    own = settle(rows.groupBy("node").agg(F.count("*").alias("copies")), "texts")
    several = small(settle(own.where(F.col("copies") > 1), "copied-texts"))
    alone = rows.join(several, "node", "left_anti").select("node", "text", F.lit(1).cast("long").alias("copies"))
    once = rows.join(several, "node").groupBy("node").agg(F.any_value("text").alias("text"), F.any_value("copies").alias("copies"))
    texts = alone.unionByName(settle(once, "copied-once"))

    met = _first_symbols(texts, threshold).groupBy("h").agg(F.sum("copies").alias("n")).where(F.col("n") > 1).select("h")
    met = settle(met, "first-symbols")
    placed = settle(_contexts(texts, threshold).join(small(met), "h"), "anchors")

    # rank the suffixes: equal contexts are one row with their number
    suffixes = placed.groupBy("whole").agg(F.sum("copies").alias("n"), *[F.any_value(c).alias(r) for c, r in (("h", "r0"), ("h1", "r1"), ("h2", "r2"), ("h3", "r3"))])
    suffixes = double(double(settle(suffixes, "suffixes"), "pairs"), "cores")

    # what all windows of an anchor span stands again: all are repeated. Else its windows meet those of its rank one by one
    sure = settle(suffixes.where(F.col("n") > 1).select("whole"), "repeated")
    mixed = suffixes.groupBy("r0").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where((F.col("least") == 1) & (F.col("kinds") > 1)).select("r0")
    open_ = suffixes.join(settle(mixed, "mixed-ranks"), "r0").select("whole", "n")
    seen = placed.join(small(settle(open_, "open-suffixes")), "whole").groupBy("whole").agg(F.any_value("n").alias("n"), F.min(F.struct("node", "lo", "hi")).alias("x"))
    asked = seen.select("x.*", (F.col("n") == 1).alias("lone"))
    lists = asked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "lone"))).alias("at"))
    windows = _windows(texts.select("node", "text").join(small(settle(lists, "windows-of-texts")), "node"), threshold)
    again = _again(windows).select("node", F.col("start").alias("a"), (F.col("start") + threshold).alias("b"))
    found = placed.join(small(sure), "whole", "left_semi").select("node", F.col("lo").alias("a"), (F.col("hi") + threshold).alias("b"))
    return settle(_spans(found.unionByName(again)), "repeated-spans")


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns spans (array of a, b, in bytes) and kept (the remaining bytes); columns of these names are replaced.

    Texts are UTF-8 bytes; a null text counts as empty, and one shorter than
    ``threshold`` has no passages. Every row of equal texts gets the same result,
    repeats of a row too, and all copies go whole. Very long texts are read in
    segments. An empty table gives an empty one; other columns come through,
    whatever their names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("spans", "kept")]
    node = unused(docs, "node")
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(node, _node(F.col("text")))
    spans = repeated_spans(docs, threshold, text_col).withColumnRenamed("node", node)
    rows = rows.join(small(spans), node, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for text, spans in zip(part.column("text"), part.column("spans"), strict=True):
                raw, at, pieces = memoryview(text.as_buffer()), 0, []
                for span in spans.as_py() or []:
                    pieces.append(raw[at : span["a"]])
                    at = span["b"]
                out.append(b"".join([*pieces, raw[at:]]))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("spans"), pa.array(out, pa.binary())], ["row", "spans", "kept"])

    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    rows = rows.select("row", "text", F.coalesce("spans", empty).alias("spans"))
    schema = rows.drop("text").withColumn("kept", F.lit(None).cast("binary")).schema
    return rows.mapInArrow(run, schema).select("row.*", "spans", "kept")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op11_suffix_array_dedup": op11_suffix_array_dedup}
ORACLE_SQL: dict[str, str] = {}
"""No SQL: DuckDB cuts text by characters, not bytes, and every window of the table would be a row; tests compare with brute force."""
