"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.quality import remainder
from larder.llm.shared import documents, settle, small
from larder.llm.textbytes import column_bytes, slices

REFERENCE_BYTES = 48 << 10
PIECE_BYTES = 4096
"""Each language's reference: at most so many bytes, of at most so many from one labelled row."""
LITERALS = 256
"""What a phrase can be besides a place in the reference: one byte."""
REFERENCE_ROWS = 4096
"""and of at most so many rows."""
SEGMENT = 512
"""Texts are parsed in runs of so many bytes side by side; the parses are then joined, so no phrase ends for it."""
SLICE = 1 << 20


class SuffixAutomaton:
    """The suffix automaton of a byte string as a table: next[state, symbol], -1 where the string has no such factor."""

    def __init__(self, text: bytes, symbols: np.ndarray):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols[np.frombuffer(text, np.uint8)].tolist():
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = np.full((len(nexts), int(symbols.max()) + 1), -1, np.int32)
        for state, out in enumerate(nexts):
            if out:
                self.next[state, list(out)] = list(out.values())


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes of lower-cased text with everything ASCII that is no letter as one separator."""
    letters = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    return np.where(letters, data, np.uint8(0x20))


@lru_cache(maxsize=2)
def automata(references: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol of each byte, the languages' tables one below the other, each language's root).

    Built once in a worker process from the short reference texts.
    """
    seen = sorted({b for _, text in references for b in text})
    symbols = np.full(256, len(seen), np.int64)
    symbols[seen] = np.arange(len(seen))
    tables, roots, states = [], [], 0
    for _, text in references:
        t = SuffixAutomaton(text, symbols).next
        t = np.pad(t, ((0, 0), (0, len(seen) + 1 - t.shape[1])), constant_values=-1)
        tables.append(np.where(t >= 0, t + states, -1).astype(np.int32))
        roots.append(states)
        states += len(t)
    tables.append(np.full((1, len(seen) + 1), -1, np.int32))  # the state before a text and after a byte that no reference has
    return symbols, np.concatenate(tables).ravel(), np.array(roots, np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray, references: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """[language, row]: how many longest matches each language needs to parse each row, from its first byte on.

    All runs of a slice advance together, one byte at a time, each as if a phrase
    began with it. Then the parse of each run goes on into the next one until a
    phrase begins where one of the next run's own does: from there on they are
    one. The phrases up to there replace those of the next run.
    """
    symbols, table, roots = automata(references)
    width = int(symbols.max()) + 1
    data = symbols[fold(data)]
    lengths = np.diff(offsets)
    per_row = -(-lengths // SEGMENT)
    row = np.repeat(np.arange(len(lengths)), per_row)
    index = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[:-1][row] + index * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][row] - start)
    out = np.zeros((len(roots), len(lengths)), np.int64)
    if not len(row):
        return out
    order = np.argsort(-size, kind="stable")
    begin, live = start[order], np.searchsorted(-size[order], -np.arange(1, SEGMENT + 1), "right")
    lost = len(table) // width - 1
    again = table.reshape(-1, width)[roots]
    again = np.where(again < 0, lost, again)  # [language, symbol]: the state after a phrase's first byte
    state = np.full((len(roots), len(row)), lost)
    fresh = np.zeros((len(roots), len(data)), bool)
    for i in range(int(size.max())):
        k = live[i]
        at = begin[:k] + i
        symbol = data[at]
        to = table[state[:, :k] * width + symbol]
        miss = to < 0
        fresh[:, at] = miss
        state[:, :k] = np.where(miss, again[:, symbol], to)
    end = np.empty_like(state)
    end[:, order] = state
    passed = np.zeros((len(roots), len(data) + 1), np.int32)
    np.cumsum(fresh, axis=1, out=passed[:, 1:])
    for lang in range(len(roots)):
        own = passed[lang, start + size] - passed[lang, start]
        own += _joined(index, start, size, data, width, table, again[lang], end[lang], fresh[lang], passed[lang])
        out[lang] = np.bincount(row, weights=own, minlength=len(lengths))
    return out


def _joined(index, start, size, data, width, table, again, alone, fresh, passed) -> np.ndarray:
    """For each run, what joining it to the one before adds to its phrases.

    ``alone`` has each run's last state if parsed by itself. A run that the parse
    from before crosses without meeting ends in another state, so the next run
    is joined anew, until no state changes.
    """
    added, end = np.zeros(len(start), np.int64), alone.copy()
    runs = np.flatnonzero(index > 0)
    while len(runs):
        live, state = runs, end[runs - 1]
        own, last = np.zeros(len(start), np.int64), end.copy()
        for i in range(SEGMENT + 1):
            over = size[live] <= i
            if over.any():
                crossed = live[over]
                added[crossed] = own[crossed] - (passed[start[crossed] + size[crossed]] - passed[start[crossed]])
                last[crossed] = state[over]
                live, state = live[~over], state[~over]
            if not len(live):
                break
            at = start[live] + i
            symbol = data[at]
            to = table[state * width + symbol]
            miss = to < 0
            met = miss & fresh[at]
            done = live[met]
            added[done] = own[done] - (passed[at[met]] - passed[start[done]])
            last[done] = alone[done]
            own[live] += miss
            live, state = live[~met], np.where(miss, again[symbol], to)[~met]
        after = runs[last[runs] != end[runs]] + 1
        end = last
        after = after[after < len(start)]
        runs = after[index[after] > 0]
    return added


def references(docs: DataFrame, total: int = REFERENCE_BYTES, most: int = PIECE_BYTES) -> tuple[tuple[str, bytes], ...]:
    """Each language's reference text from the rows that are not held out (remainder 1 of 3).

    Every labelled row with text, short or long, is eligible and gives one piece
    of at most ``most`` bytes, from a place its hash picks. A language takes the
    pieces with the smallest hashes of identifier and text until it has ``total``
    bytes or REFERENCE_ROWS rows, or all it has; what another language has does
    not matter.
    """
    h, raw = F.xxhash64("doc_id", "text"), F.encode(F.lower(F.col("text")), "UTF-8")
    known = docs.where(F.col("lang").isNotNull() & (remainder("doc_id", 3) != 1) & (F.octet_length("text") > 0))
    known = known.select("lang", "doc_id", h.alias("h"), raw.alias("raw"))
    start = F.pmod(F.col("h"), F.greatest(F.octet_length("raw") - most + 1, F.lit(1))).cast("int") + 1
    known = known.select("lang", "doc_id", "h", F.substring(F.col("raw"), start, F.lit(most)).alias("piece"))
    size = F.octet_length("piece") + 1
    # Rows that repeat an identifier and its text share a hash and a piece: they count, and are taken, once.
    counts = known.groupBy("lang", "h").agg(F.max(size).alias("size")).groupBy("lang").agg(F.sum("size").alias("n"))
    # About four times the bytes asked for and 64 pieces, picked by hash, so that little is sorted; the limit by row
    # is applied in each task first, so rows that share a hash are no group for one task either.
    picked = known.join(small(settle(counts, "bytes-of-languages")), "lang").where(
        F.pmod(F.col("h"), F.lit(1 << 40)) < F.lit(float((4 * total + 64 * most) * (1 << 40))) / F.col("n") + F.lit(1)
    )
    picked = picked.dropDuplicates(["lang", "h", "piece"])
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "piece")
    first = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= REFERENCE_ROWS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    best = first.withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("before") < total)
    found: dict[str, list] = {}
    for r in best.select("lang", "before", "piece").collect():
        found.setdefault(r["lang"], []).append((r["before"], bytes(r["piece"])))
    return tuple(
        (lang, bytes(fold(np.frombuffer(b" ".join(x for _, x in sorted(found[lang])), np.uint8)))[:total]) for lang in sorted(found)
    )


def identify(docs: DataFrame, learned: tuple[tuple[str, bytes], ...] | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    The language that writes the whole lower-cased text in fewest bits wins,
    ties to the first by name: a phrase takes the logarithm of the reference's
    length and LITERALS, so that references of unlike length compare. ``score``
    is 1 / (1 + r ** 8), r the winner's bits over the runner-up's; 1 with one language. A text that is null or has
    no letter is 'und' with score 0, as is every text when nothing was learned.
    Repeated rows get equal results; other columns are ignored.
    """
    learned = references(docs) if learned is None else learned
    names = np.array([lang for lang, _ in learned], object)
    bits = np.log2([[len(text) + LITERALS] for _, text in learned])
    rows = docs.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        F.lower(F.coalesce("text", F.lit(""))).alias("text"),
    )
    if not learned:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            cost = phrases(*column_bytes(part.column("text")), learned) * bits
            order = np.argsort(cost, axis=0, kind="stable")
            best = np.take_along_axis(cost, order[:1], 0)[0]
            score = np.ones(part.num_rows)
            if len(names) > 1:
                second = np.take_along_axis(cost, order[1:2], 0)[0]
                score = 1 / (1 + (best / np.maximum(second, 1)) ** 8)
            lettered = part.column("lettered").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(np.where(lettered, names[order[0]], "und"), pa.string()),
                    pa.array(np.where(lettered, score, 0.0)),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    schema = rows.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
