"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

An index of all shingles comes first. It gives every shingle's exact document
frequency, and it says which shingles of a document no other has. Only the
others can be shared, so their weight bounds every similarity of the document
from above: most documents are done here. The rest are sampled and banded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.shared import documents, is_small, partitions, settle, small, unused
from larder.llm.textbytes import LOWER_WORD, Words, column_bytes, mix, numbers, planes, run_starts, slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
"""Two texts of weighted Jaccard similarity 0.8 share no band with probability (1 - 0.8**3)**12 < 0.0002."""
CHUNK = 1 << 19
"""About how many shingles a task sorts at once, before they are shuffled."""
PART = 1 << 20
"""About how many shingles are counted together."""
OFTEN = 16
"""A shingle that more documents of a chunk have is sent as a count, so that no part follows a frequent shingle."""
OFTEN_BYTES = 16 << 20
"""Counts of frequent shingles are broadcast up to so many bytes, else joined."""
SKETCH = 32
CELL = 0.01
"""Open documents of a bucket are bounded together if the logarithms of their weights differ by no more."""
NODE = 12
"""Bytes of the SHA-256 that names a text."""
PIVOTS = 4
"""Rounds in which a bucket is compared with one member; they only spare work, and what they leave is compared after."""
_SLACK = 1e-4
"""Sketches hold 32-bit numbers; what they allow is widened by this share."""
_CELLS = 1 << 16
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, times) of each row's distinct shingles, by row, then hash. A text of fewer words is one shingle."""
    h, row, _ = Words(data, offsets, LOWER_WORD).windows(SHINGLE, short=True)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = run_starts(h) if not len(h) else np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[first], row[first], np.diff(np.r_[first, len(h)])


def idf(frequency: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency among ``n`` documents, normalised: 2 for a shingle of one document, 1 for one of all.

    So a passage that a third of the corpus has still weighs about half as much
    as a document's own words, in a corpus of any size.
    """
    n = max(n, 1)
    return 1 + np.log((n + 1) / np.asarray(frequency, float)) / np.log(n + 1)


@lru_cache(maxsize=2)
def _draws(other: float) -> tuple[np.ndarray, ...]:
    """For each sample and cell: r, ln c and beta; and the finished key of a shingle that has the weight ``other``."""
    rng = np.random.default_rng(11)
    k = BANDS * ROWS
    r = rng.gamma(2.0, 1.0, (k, _CELLS)).astype(np.float32)
    ln_c = np.log(rng.gamma(2.0, 1.0, (k, _CELLS))).astype(np.float32)
    beta = rng.random((k, _CELLS)).astype(np.float32)
    keys = np.stack([_key(np.log(np.full(_CELLS, other)), r[i], ln_c[i], beta[i]) for i in range(k)])
    multipliers = rng.integers(1 << 62, 1 << 63, k, dtype=np.uint64) | _U(1)
    return r, ln_c, beta, keys, multipliers


def _key(ln_weight: np.ndarray, r: np.ndarray, ln_c: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """ln a of the sample, as bits that sort, above a hash of its quantised weight t."""
    t = np.floor(ln_weight / r + beta)
    bits = (ln_c - r * (t - beta + 1)).astype(np.float32).view(np.uint32)
    bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(_U)
    return bits << _U(32) | ((t.astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(32))


def band_hashes(h: np.ndarray, row: np.ndarray, weight: np.ndarray, other: float) -> np.ndarray:
    """[row that has shingles, band] - equal where all samples of the band are equal.

    A shingle's draws come from a cell that its hash picks for each sample. The
    least key of a row names the sampled shingle and its quantised weight.
    """
    r, ln_c, beta, keys, multipliers = _draws(other)
    first = run_starts(row)
    rare = np.flatnonzero(weight != other)
    ln_weight = np.log(weight[rare])
    low = h & _U(0xFFFFFFFF)
    out = np.zeros((len(first), BANDS), _U)
    for k in range(BANDS * ROWS):
        cell = ((h * multipliers[k]) >> _U(48)).view(np.int64)
        key = keys[k][cell]
        if len(rare):
            c = cell[rare]
            key[rare] = _key(ln_weight, r[k][c], ln_c[k][c], beta[k][c])
        least = np.minimum.reduceat(key ^ low, first)
        band = out[:, k // ROWS]
        band ^= least & _U(0xFFFFFFFF)
        band *= _U(0x9E3779B97F4A7C15)
        band ^= band >> _U(31)
    return (out * _U(BANDS)) + np.arange(BANDS, dtype=_U)


def _pieces(batches: Iterator[pa.RecordBatch], *columns: str, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the lists of a piece have about ``most`` entries; a longer list is a piece of its own."""
    for batch in batches:
        ends = sum(np.asarray(batch.column(c).offsets).astype(np.int64) for c in columns)
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, min(int(np.searchsorted(ends, ends[first] + most, "right")) - 1, batch.num_rows))
            yield batch.slice(first, last - first)
            first = last


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """``values``, ordered by owner, as one list for each of ``n`` owners."""
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))


def _rows(names: list[str], **columns) -> pa.RecordBatch:
    """A batch of the columns ``names``; those not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n)) for c in names], names)


def _bucket(nodes: np.ndarray, n: int) -> np.ndarray:
    """The part that gathers each text's shingles."""
    raw = nodes.view(np.uint8).reshape(-1, NODE).astype(np.int64)
    return (((raw[:, 0] << 24 | raw[:, 1] << 16 | raw[:, 2] << 8 | raw[:, 3]) * n) >> 32).astype(np.int32)


_POSTED = "part int, node binary, copies long, k long, h binary, at binary, times binary, nodes binary, each binary, often binary, among binary, holders binary, mine binary, tf binary"
_P = [c.split()[0] for c in _POSTED.split(", ")]
_SEEN = "bucket int, node binary, copies long, k long, h array<long>, n array<long>, tf array<int>, nodes binary, sizes binary, hs binary, ns binary, tfs binary"
_S = [c.split()[0] for c in _SEEN.split(", ")]


def _fixed(batch: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([batch.column(c).cast(kinds[t]) for c, t in zip(names, types, strict=True)], list(names))


def _postings(n_parts: int):
    """Rows of the index: one for each document, and one for each part and chunk.

    A part holds a range of hashes. Its entries are h, the place ``at`` of their
    document among ``nodes``, and ``times``; ``each`` are the documents' copies.
    ``often`` are frequent shingles with how many documents of the chunk, and how
    many different texts, have them. A document's row has its number of shingles
    and which of them (``mine``, ``tf``) were frequent.
    """

    def post(held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[0] for x in held])
        before = np.cumsum([0, *(len(x[3]) for x in held)]).astype(np.uint32)
        at = np.concatenate([x[1] + b for x, b in zip(held, before, strict=False)])
        times = np.concatenate([x[2] for x in held])
        nodes = np.concatenate([x[3] for x in held])
        copies = np.concatenate([x[4] for x in held])
        k = np.bincount(at, times, len(nodes)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, at, times = h[order], at[order], times[order]
        first = run_starts(h)
        count = np.diff(np.r_[first, len(h)])
        frequent = count > OFTEN
        among = np.add.reduceat(copies[at], first)[frequent] if len(first) else np.zeros(0, np.int64)
        often, holders = h[first[frequent]], count[frequent]
        apart = np.repeat(frequent, count)
        own = np.flatnonzero(apart)
        own = own[np.argsort(at[own], kind="stable")]
        ends = np.cumsum(np.bincount(at[own], minlength=len(nodes)))
        mine, tf = h[own], times[own]
        spans = list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True))
        yield _rows(
            _P, part=pa.array(-1 - _bucket(nodes, n_parts)), node=pa.array([x.tobytes() for x in nodes.view(f"V{NODE}").ravel()]), copies=copies, k=k,
            mine=pa.array([mine[a:b].tobytes() for a, b in spans]), tf=pa.array([tf[a:b].tobytes() for a, b in spans]),
        )
        h, at, times = h[~apart], at[~apart], times[~apart]
        bounds = (np.arange(1, n_parts, dtype=np.uint64) * _U((1 << 64) // n_parts)) if n_parts > 1 else np.zeros(0, _U)
        cut = np.r_[0, np.searchsorted(h, bounds), len(h)]
        cut_often = np.r_[0, np.searchsorted(often, bounds), len(often)]
        out: dict[str, list] = {c: [] for c in ("part", "h", "at", "times", "nodes", "each", "often", "among", "holders")}
        for p in range(n_parts):
            a, b, c, d = cut[p], cut[p + 1], cut_often[p], cut_often[p + 1]
            if a == b and c == d:
                continue
            present, local = np.unique(at[a:b], return_inverse=True)
            for name, value in (
                ("part", p), ("h", planes(h[a:b])), ("at", planes(local.astype(np.uint32))), ("times", planes(times[a:b])), ("nodes", nodes[present].tobytes()),
                ("each", planes(copies[present])), ("often", planes(often[c:d])), ("among", planes(among[c:d].astype(np.int64))), ("holders", planes(holders[c:d].astype(np.int64))),
            ):
                out[name].append(value)
        yield _rows(_P, **out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            h, row, times = shingles(*column_bytes(part.column("text")))
            raw = np.frombuffer(b"".join(part.column("node").to_pylist()), f"V{NODE}")
            held.append((h, row.astype(np.uint32), times.astype(np.uint32), raw, part.column("copies").to_numpy()))
            size += len(h)
            if size >= CHUNK:
                yield from (_fixed(x, _POSTED) for x in post(held))
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from (_fixed(x, _POSTED) for x in post(held))

    return run


def _count(n_parts: int):
    """Of rows sorted by part: the shingles that several texts have, with their document frequencies, as blocks by ``bucket``.

    Rows of documents pass; rows without a bucket have the frequencies of frequent
    shingles.
    """

    def flush(held: list[list]) -> Iterator[pa.RecordBatch]:
        n_light = sum(len(x[0]) for x in held)
        h = np.concatenate([x[0] for x in held] + [x[5] for x in held])
        order = np.argsort(h)
        alike = h[order]
        alike = np.flatnonzero(alike[1:] == alike[:-1])
        again = np.zeros(len(h), bool)  # in sorted order: what stands more than once, and all counts
        again[alike] = again[alike + 1] = True
        again |= order >= n_light
        order = order[again]
        if not len(order):
            return
        h = h[order]
        first = run_starts(h)
        nodes = np.concatenate([x[3] for x in held])
        before = np.cumsum([0, *(len(x[3]) for x in held)])
        light = order < n_light
        at = np.full(len(order), -1)
        at[light] = np.concatenate([x[1] + np.uint32(b) for x, b in zip(held, before, strict=False)])[order[light]]
        times = np.concatenate([x[2] for x in held])
        among, holders = np.ones(len(order), np.int64), np.ones(len(order), np.int64)
        among[light] = np.concatenate([x[4] for x in held])[at[light]]
        among[~light] = np.concatenate([x[6] for x in held])[order[~light] - n_light]
        holders[~light] = np.concatenate([x[7] for x in held])[order[~light] - n_light]
        n, m = np.add.reduceat(among, first), np.add.reduceat(holders, first)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
        counted = np.unique(group[~light])
        if len(counted):
            one = np.zeros(len(counted), np.int64)
            yield _rows(_S, h=_lists(h[first][counted].view(np.int64), one, 1), n=_lists(n[counted], one, 1))
        own = np.flatnonzero(light & (m[group] > 1))
        if not len(own):
            return
        own = own[np.argsort(at[own], kind="stable")]
        present, sizes = np.unique(at[own], return_counts=True)
        goal = _bucket(nodes[present], n_parts)
        turn = np.argsort(goal, kind="stable")
        own = own[np.argsort(np.repeat(goal, sizes), kind="stable")]
        present, sizes, goal = present[turn], sizes[turn], goal[turn]
        first = run_starts(goal)
        ends, spans = np.r_[0, np.cumsum(sizes)], np.r_[first, len(goal)]
        hs, ns, tfs = h[own], n[group[own]], times[order[own]]
        cuts = [(a, b, ends[a], ends[b]) for a, b in zip(spans[:-1], spans[1:], strict=True)]
        yield _rows(
            _S, bucket=pa.array(goal[first]), nodes=pa.array([nodes[present[a:b]].tobytes() for a, b, _, _ in cuts]), sizes=pa.array([planes(sizes[a:b].astype(np.int64)) for a, b, _, _ in cuts]),
            hs=pa.array([planes(hs[c:d]) for _, _, c, d in cuts]), ns=pa.array([planes(ns[c:d]) for _, _, c, d in cuts]), tfs=pa.array([planes(tfs[c:d]) for _, _, c, d in cuts]),
        )

    kinds = {"h": _U, "at": np.uint32, "times": np.uint32, "nodes": None, "each": np.int64, "often": _U, "among": np.int64, "holders": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        current = None
        for batch in batches:
            lone = batch.filter(pc.less(batch.column("part"), 0))
            if lone.num_rows:
                mine = [np.frombuffer(x, np.int64) for x in lone.column("mine").to_pylist()]
                tf = [np.frombuffer(x, np.int32) for x in lone.column("tf").to_pylist()]
                bucket = -1 - lone.column("part").to_numpy()
                found = _rows(_S, bucket=bucket, **{c: lone.column(c) for c in ("node", "copies", "k")}, h=pa.array(mine, pa.list_(pa.int64())), tf=pa.array(tf, pa.list_(pa.int32())))
                yield _fixed(found, _SEEN)
            blocks = batch.filter(pc.greater_equal(batch.column("part"), 0))
            for i, part in enumerate(blocks.column("part").to_pylist()):
                if held and part != current:
                    yield from (_fixed(y, _SEEN) for y in flush(held))
                    held = []
                    pa.default_memory_pool().release_unused()
                current, raw = part, {c: blocks.column(c)[i].as_py() for c in kinds}
                held.append([np.frombuffer(raw[c], f"V{NODE}") if kind is None else numbers(raw[c], kind) for c, kind in kinds.items()])
        if held:
            yield from (_fixed(y, _SEEN) for y in flush(held))

    return run


_GATHERED = "node binary, copies long, k long, h array<long>, n array<long>, tf array<int>"
_G = [c.split()[0] for c in _GATHERED.split(", ")]


def _gather(frequent: Broadcast | None):
    """Of rows sorted by bucket: one row for each text that has shared shingles.

    ``frequent``: sorted hashes and document frequencies of the frequent ones;
    without it they are not yet among a text's shingles.
    """
    key = np.dtype([("a", ">u8"), ("b", ">u4")])

    def flush(docs: list[tuple], blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = np.concatenate([np.frombuffer(b"".join(d[0] for d in docs), f"V{NODE}"), *(x[0] for x in blocks)])
        sizes = np.concatenate([np.zeros(len(docs), np.int64), *(x[1] for x in blocks)])
        parts = names.view(key)
        order = np.lexsort((parts["b"], parts["a"]))
        fresh = np.r_[True, names[order][1:] != names[order][:-1]]
        text = np.empty(len(names), np.int64)
        text[order] = np.cumsum(fresh) - 1
        n = int(fresh.sum())
        copies, k, often = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        copies[text[: len(docs)]], k[text[: len(docs)]] = ([d[i] for d in docs] for i in (1, 2))
        often[text[: len(docs)]] = [len(d[3]) > 0 for d in docs]
        columns = [np.concatenate([np.zeros(0, kind), *(x[i] for x in blocks)]) for i, kind in ((2, np.int64), (3, np.int64), (4, np.uint32))]
        owner = np.repeat(text, sizes)
        if frequent is not None and docs:
            mine = np.concatenate([np.zeros(0, np.int64), *(np.asarray(d[3], np.int64) for d in docs)])
            known, n_known = frequent.value
            more = [mine, n_known[np.searchsorted(known, mine)] if len(mine) else mine, np.concatenate([np.zeros(0, np.uint32), *(np.asarray(d[4], np.uint32) for d in docs)])]
            columns = [np.concatenate(x) for x in zip(columns, more, strict=True)]
            owner = np.r_[owner, np.repeat(text[: len(docs)], [len(d[3]) for d in docs])]
        turn = np.argsort(owner, kind="stable")
        columns, owner = [x[turn] for x in columns], owner[turn]
        lists = [_lists(x.astype(np.int32) if i == 2 else x, owner, n) for i, x in enumerate(columns)]
        some = pa.array(np.flatnonzero(often | (np.bincount(owner, minlength=n) > 0)))
        yield _fixed(_rows(_G, node=pa.array([x.tobytes() for x in names[order][fresh]]).take(some), copies=pa.array(copies).take(some), k=pa.array(k).take(some), h=lists[0].take(some), n=lists[1].take(some), tf=lists[2].take(some)), _GATHERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        blocks: list[tuple] = []
        current = None
        for batch in batches:
            for r in batch.to_pylist():
                if current is not None and r["bucket"] != current:
                    yield from flush(docs, blocks)
                    docs, blocks = [], []
                current = r["bucket"]
                if r["node"] is not None:
                    docs.append((r["node"], r["copies"], r["k"], r["h"], r["tf"]))
                else:
                    blocks.append((np.frombuffer(r["nodes"], f"V{NODE}"), numbers(r["sizes"], np.int64), numbers(r["hs"], np.int64), numbers(r["ns"], np.int64), numbers(r["tfs"], np.uint32)))
        if docs or blocks:
            yield from flush(docs, blocks)

    return run


def shared_shingles(texts: DataFrame, n_bytes: int) -> DataFrame:
    """node, copies, k, of (array of h, n, tf) of each row of node, text, copies that shares a shingle with another.

    ``of`` are its shingles that other texts have too, ``n`` how many documents
    have each, counted over all; a row stands for ``copies`` documents. ``k`` is
    the number of all its shingles, repeats included. ``n_bytes`` (of the texts)
    only sets how many parts the index has.

    Every shingle is shuffled once, as part of a sorted block, and those that are
    shared once more, in blocks by their text. Frequent ones are counted in each chunk first and their
    counts joined to the documents, so no key gathers the rows of a hot shingle.
    """
    n_parts = max(partitions(texts.sparkSession), -(-n_bytes // (6 * PART)))
    posted = texts.select("node", "text", "copies").mapInArrow(_postings(n_parts), _POSTED)
    seen = settle(posted.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(_count(n_parts), _SEEN), "shared-shingles")
    counts = settle(seen.where(F.col("bucket").isNull()).select(F.explode(F.arrays_zip("h", "n")).alias("x")).select("x.h", "x.n"), "frequent-shingles")
    frequent = None
    if is_small(counts, OFTEN_BYTES):
        known = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 2)
        known = known[np.argsort(known[:, 0])]
        frequent = texts.sparkSession.sparkContext.broadcast((known[:, 0], known[:, 1]))
    blocks = seen.where(F.col("bucket").isNotNull()).select("bucket", "node", "copies", "k", "h", "tf", "nodes", "sizes", "hs", "ns", "tfs")
    lists = blocks.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather(frequent), _GATHERED)
    lists = lists.select("node", "copies", "k", F.arrays_zip("h", "n", "tf").alias("of"))
    if frequent is None:
        often = seen.where(F.col("node").isNotNull() & (F.size("h") > 0)).select("node", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("node", "x.h", "x.tf")
        often = often.join(counts, "h").groupBy("node").agg(F.collect_list(F.struct("h", "n", "tf")).alias("more"))
        none = F.array().cast("array<struct<h:bigint,n:bigint,tf:int>>")
        lists = lists.join(often, "node", "left").select("node", "copies", "k", F.concat("of", F.coalesce("more", none)).alias("of"))
    return lists.where(F.size("of") > 0)


def signatures(lists: DataFrame, n: int, similarity: float) -> DataFrame:
    """node, total, most, sketch, h, w, bands of the rows of ``shared_shingles`` that could be similar to another.

    ``total`` is the weight of all shingles, ``most`` that of the shared ones: no
    other text can share more, so a row with less than ``similarity`` of its
    weight in them is left out. ``sketch`` spreads ``most`` over SKETCH numbers by
    hash: two texts share at most the sum of the smaller ones. The other shingles
    are nobody else's, so only their number counts for the samples; made-up
    hashes stand for them.
    """
    other = float(idf(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "of"):
            of, k, copies = batch.column("of"), batch.column("k").to_numpy(), batch.column("copies").to_numpy()
            flat, rows = of.flatten(), batch.num_rows
            row = np.repeat(np.arange(rows), np.diff(of.offsets.to_numpy()))
            h = flat.field("h").to_numpy().view(_U)
            tf = flat.field("tf").to_numpy()
            w = idf(flat.field("n").to_numpy(), n) * tf
            most, lone = np.bincount(row, w, rows), k - np.bincount(row, tf, rows).astype(np.int64)
            total = most + lone * idf(copies, n)
            pick = np.flatnonzero(most >= similarity * total - 1e-9)
            for some in np.array_split(pick, max(1, int(k[pick].sum()) >> 17)):
                if not len(some):
                    continue
                place = np.full(rows, -1)
                place[some] = np.arange(len(some))
                own = np.flatnonzero(place[row] >= 0)
                at, count = place[row[own]], lone[some]
                alone = np.repeat(np.arange(len(some)), count)
                seed = np.array([int.from_bytes(batch.column("node")[int(i)].as_py()[:8], "little") for i in some], _U)
                made = mix(seed[alone] + (np.arange(len(alone)) - np.repeat(np.cumsum(count) - count, count)).astype(_U))
                every, whose = np.r_[h[own], made], np.r_[at, alone]
                weight = np.r_[w[own], idf(copies[some], n)[alone]]
                order = np.argsort(whose, kind="stable")
                bands = band_hashes(every[order], whose[order], weight[order], other)
                sketch = np.bincount(at * SKETCH + (mix(h[own]) % _U(SKETCH)).astype(np.int64), w[own], len(some) * SKETCH)
                spread = lambda x, size: pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * size), pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(pa.array(some)), pa.array(total[some]), pa.array(most[some]), spread(sketch.astype(np.float32), SKETCH),
                        _lists(h[own].view(np.int64), at, len(some)), _lists(w[own], at, len(some)), spread(bands.ravel().view(np.int64), BANDS),
                    ],
                    ["node", "total", "most", "sketch", "h", "w", "bands"],
                )

    return lists.mapInArrow(run, "node binary, total double, most double, sketch array<float>, h array<long>, w array<double>, bands array<long>")


def similarities(pairs: DataFrame) -> DataFrame:
    """a, b, similarity for rows of a, b and each side's total, h and w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "h_a", "h_b"):
            n = batch.num_rows
            sides = []
            for x in "ab":
                lists = batch.column(f"h_{x}")
                sides.append((np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), batch.column(f"w_{x}").flatten().to_numpy()))
            row, h, w = (np.concatenate(x) for x in zip(*sides, strict=True))
            order = np.lexsort((h, row))
            row, h, w = row[order], h[order], w[order]
            twice = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
            both = np.bincount(row[twice], np.minimum(w[twice], w[twice + 1]), n)
            total = batch.column("total_a").to_numpy() + batch.column("total_b").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both / np.maximum(total - both, 1e-12))], ["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges a, b.

    Each round gives every node the smallest label among its neighbours and its
    own, then the label of that label. Rounds follow the logarithm of the longest
    chain; the lineage is cut each round.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("least"))
        of = labels.select(F.col("node").alias("l"), F.col("label").alias("up"))
        step = step.join(of, step["least"] == of["l"], "left").select("node", "label", F.least("least", F.coalesce("up", "least")).alias("now"))
        step = settle(step, "labels")
        moved = step.where(F.col("now") != F.col("label")).limit(1).count()
        labels = step.select("node", F.col("now").alias("label"))
        if not moved:
            return labels.select("node", F.col("label").alias("component"))


def _verify(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The links among the pairs a, b."""

    def side(x: str) -> DataFrame:
        return signed.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("total", "h", "w")])

    met = pairs.join(side("b"), "b").join(side("a"), "a")
    return settle(similarities(met).where(F.col("similarity") >= similarity - 1e-9).select("a", "b"), "links")


def _needed(similarity: float, a: Column, b: Column) -> Column:
    """How much weight texts of the total weights ``a`` and ``b`` share at that similarity, a little less for rounding."""
    return (a + b) * (similarity / (1 + similarity)) * (1 - _SLACK)


def _common(a: Column, b: Column) -> Column:
    """The most that two sketches allow."""
    return reduce(lambda x, y: x + y, [F.least(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(SKETCH)])


def _open_pairs(members: DataFrame, labels: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Distinct a, b of a bucket that are not of one component and that the sketches allow to be similar.

    A bucket's largest part is the component of its pivot. Each node outside it
    meets the cells of the bucket - nodes of nearly equal weight, bounded
    together - and then the nodes of the cells that its bound cannot rule out.
    """
    rows = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = rows.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.struct("company", "node", "component"))["component"].alias("main")
    )
    ends = settle(ends.where(F.col("x") != F.col("y")).select("bucket", "main"), "open-buckets")
    rows = rows.join(ends, "bucket").join(signed.select("node", "sketch"), "node")
    rows = settle(rows.select("bucket", "node", "component", "main", "total", "most", "sketch", F.floor(F.log("total") / CELL).alias("cell")), "open-nodes")
    cells = rows.groupBy("bucket", "cell").agg(
        F.min("total").alias("ct"), F.max("most").alias("cm"), *[F.max(F.get("sketch", F.lit(i))).alias(f"s{i}") for i in range(SKETCH)]
    )
    cells = settle(cells.select("bucket", "cell", "ct", "cm", F.array(*[f"s{i}" for i in range(SKETCH)]).alias("cs")), "open-cells")
    out = rows.where(F.col("component") != F.col("main")).drop("main", "cell")
    need = _needed(similarity, F.col("total"), F.col("ct"))
    met = out.join(cells, "bucket").where((F.least("most", "cm") >= need) & (_common(F.col("sketch"), F.col("cs")) >= need))
    met = settle(met.select("bucket", "cell", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("total").alias("ta"), F.col("most").alias("ma"), F.col("sketch").alias("sa")), "open-bounds")
    need = _needed(similarity, F.col("total"), F.col("ta"))
    close = rows.join(met, ["bucket", "cell"]).where(
        (F.col("component") != F.col("ca")) & (F.least("most", "ma") >= need) & (_common(F.col("sketch"), F.col("sa")) >= need)
    )
    return settle(close.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "open-pairs")


def linked(texts: DataFrame, n: int, n_bytes: int, similarity: float = SIMILARITY) -> DataFrame:
    """node, component of the nodes of node, text, copies (each node once) that verified links connect to others.

    ``n`` counts the documents. Each bucket of a band is compared with its most
    central member, the one with most company in all its buckets; then, while
    links are found and at most PIVOTS times, with the most central one outside
    the components of those before. Members that are still not of one component
    are compared wherever their sketches allow a link, so none between components
    is left out.
    """
    signed = settle(signatures(shared_shingles(texts, n_bytes), n, similarity), "signatures")
    members = signed.select("node", "total", "most", F.explode("bands").alias("bucket"))
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = settle(members.join(settle(several, "buckets"), "bucket"), "members")
    company = settle(members.groupBy("node").agg(F.sum("n").alias("company")), "company")
    members = settle(members.join(company, "node").select("bucket", "node", "total", "most", "company"), "members")
    labels = settle(members.select("node", F.col("node").alias("component")).distinct(), "labels")
    tried = None
    for r in range(PIVOTS):
        rows = members.join(labels, "node")
        ends = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        rows = settle(rows.join(settle(ends.where(F.col("x") != F.col("y")).select("bucket"), "open-buckets"), "bucket"), "open-members")
        left = rows
        if tried is not None:
            known = settle(tried.join(labels, "node").select("bucket", "component").distinct(), "tried-components")
            left = rows.join(known, ["bucket", "component"], "left_anti")
        central = left.groupBy("bucket").agg(F.max(F.struct("company", "node", "total", "most", "component")).alias("p"))
        central = settle(central.select("bucket", *[F.col(f"p.{c}").alias(x) for c, x in (("node", "a"), ("total", "ta"), ("most", "ma"), ("component", "ca"))]), "central")
        need = _needed(similarity, F.col("total"), F.col("ta"))
        pairs = rows.join(central, "bucket").where((F.col("component") != F.col("ca")) & (F.least("most", "ma") >= need))
        pairs = settle(pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "pairs")
        links = _verify(pairs, signed, similarity)
        if not links.limit(1).count():
            break
        stars = labels.where(F.col("component") != F.col("node")).select(F.col("component").alias("a"), F.col("node").alias("b"))
        joined = components(stars.unionByName(links)).withColumnRenamed("component", "now")
        labels = settle(labels.join(joined, "node", "left").select("node", F.coalesce("now", "component").alias("component")), "labels")
        done = central.select("bucket", F.col("a").alias("node"))
        tried = done if tried is None else tried.unionByName(done)
    links = _verify(_open_pairs(members, labels, signed, similarity), signed, similarity)
    stars = labels.where(F.col("component") != F.col("node")).select(F.col("component").alias("a"), F.col("node").alias("b"))
    return components(stars.unionByName(links)) if links.limit(1).count() else labels


def _classes(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node, class_id, class_size of every row."""
    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), _node(lowered).alias("node"), lowered.alias("text"))
    own = rows.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.sum(F.octet_length("text")).alias("bytes"))
    own = settle(own, "texts")
    several = settle(own.where(F.col("class_size") > 1).select("node"), "copied")
    alone = rows.join(small(several), "node", "left_anti").select("node", "text", F.lit(1).cast("long").alias("copies"))
    once = rows.join(small(several), "node", "left_semi").groupBy("node").agg(F.max("text").alias("text"), F.count("*").alias("copies"))
    whole = own.agg(F.sum("class_size").alias("n"), F.sum(F.col("bytes") / F.col("class_size")).cast("long").alias("bytes")).first()
    labels = linked(alone.unionByName(once), whole["n"] or 0, whole["bytes"] or 0, similarity)
    joint = own.select("node", "class_id", "class_size").join(labels, "node")
    joint = settle(joint.groupBy("component").agg(F.min("class_id").alias("class_id"), F.sum("class_size").alias("class_size")), "classes")
    joint = settle(labels.join(small(joint), "component").select("node", F.struct("class_id", "class_size").alias("of")), "linked-texts")
    of = own.join(small(joint), "node", "left").select("node", F.coalesce("of", F.struct("class_id", "class_size")).alias("of"))
    return rows.select("doc_id", "node").join(settle(of, "class-of-texts"), "node").select("doc_id", "node", "of.*")


def _node(lowered: Column) -> Column:
    """96 bits of the SHA-256 of a lower-cased text."""
    return F.unhex(F.substring(F.sha2(lowered, 256), 1, 2 * NODE))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    A class is what links of weighted Jaccard similarity >= ``similarity`` over
    shingles of five words connect, its id the smallest identifier in it. Words:
    runs of digits, letters and characters beyond ASCII of the lower-cased text. A
    text of one to four words is one shingle; texts without words are alike only
    if they are equal after lower-casing. A null text counts as empty. Rows with
    the same identifier and class share a decision; a class of null identifiers
    only has a null class_id. An empty table gives an empty result; other columns
    are ignored.

    Equal texts are one node, found by their hash, so copies are never compared.
    """
    return _classes(docs, similarity, id_col, text_col).select(
        "doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near duplicates the row with the smallest doc_id.

    Of rows that repeat this identifier and its text, one stays.
    """
    found = settle(_classes(docs, similarity, "doc_id", "text"), "near-classes")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "node").distinct()
    again = found.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    gone = small(settle(gone, "near-copies"))
    node = unused(docs, "node")
    keyed = docs.withColumn(node, _node(F.lower(F.coalesce("text", F.lit(""))))).alias("d")
    left = keyed.join(
        gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{node}") == F.col("g.node")), "left_anti"
    )
    if again.limit(1).count():
        left = left.dropDuplicates(["doc_id", node])
    return left.select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE_SQL: dict[str, str] = {}
