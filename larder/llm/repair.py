"""Repair of damaged conversations: the cheapest edits to a well-formed turn order, by an auction over an edit lattice.

Nodes of the lattice are (rows consumed, state of the turn order). An auction
grows a path from the start: at its end it extends along the cheapest arc at the
present prices, or, where the node's price has fallen behind, raises the price
and contracts by one arc. When the path arrives, the prices along it are exact
distances. Arcs of equal cost are tried in the order of their letters, so the
path is the least of the cheapest ones.

Conversations of any length are cut in segments. A long conversation's segments
are reduced to the distances between their ends; from these follow the prices
behind each segment, and each is then traced on its own between known ends. What
meets by conversation is a stream, read with a state of a few numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from larder.llm.shared import partitions, settle, small, table

SEGMENT_BITS = 6
"""A segment has at most 2**6 rows."""
SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
FINAL = (0, FAR, FAR, 0)
"""Behind the last row only these states end well; BEHIND has the inserts that the others need."""
BEHIND = (0, 2 * INSERT, INSERT, 0)
NEXT = (USER, USER, ASSISTANT, USER)
"""The state that an inserted or renamed turn leads to; only these two roles are ever given."""
ROLE = {USER: "user", ASSISTANT: "assistant"}
LETTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
GOOD = ("su", "ua", "au")


@lru_cache(maxsize=64)
def _arcs(code: str, state: int, inserts: bool) -> tuple[tuple[str, int, bool, int], ...]:
    """(letter, cost, whether it consumes the row, next state), by letter.

    ``code`` is a row: '-' must go; else its role's letter ('x': another), a
    capital where the row is truncated.
    """
    out = [("D", DELETE, True, state)]
    if inserts:
        out.append(("I", INSERT, False, NEXT[state]))
    if code != "-":
        more, to = int(code.isupper()), LETTER.get(code.lower())
        if to is not None and (to == NEXT[state] or to == SYSTEM and state == START):
            out.append(("K", KEEP + more, True, to))
        out.append(("R", REROLE + more, True, NEXT[state]))
    return tuple(sorted(out))


def auction(codes: str, entry: int, exits: tuple[int, ...], last: bool = True) -> tuple[int, list[tuple[str, int]]]:
    """(distance, path as (letter, state after)) from ``entry`` ahead of the rows ``codes`` to the best exit.

    ``exits`` are the prices of the states behind the rows. Only a conversation's
    ``last`` segment inserts behind its last row, so no path stands twice.
    """
    m = len(codes)
    price = [[0] * 4 for _ in range(m + 1)]

    def best(k: int, state: int) -> tuple[int, str, int, int]:
        least = (FAR, "", 0, 0)
        for letter, cost, consumes, to in _arcs(codes[k], state, True) if k < m else (("I", INSERT, False, NEXT[state]),) if last else ():
            value = cost + price[k + consumes][to]
            if value < least[0]:
                least = (value, letter, k + consumes, to)
        if k == m and exits[state] <= least[0]:
            least = (exits[state], "", m, state)
        return least

    path: list[tuple[str, int, int]] = [("", 0, entry)]
    while True:
        _, k, state = path[-1]
        value, letter, to_k, to = best(k, state)
        if value >= FAR and len(path) == 1:
            return FAR, []
        if price[k][state] < value:
            price[k][state] = value
            if len(path) > 1:
                path.pop()
        elif letter:
            path.append((letter, to_k, to))
        else:
            return price[0][entry], [(letter, to) for letter, _, to in path[1:]]


@lru_cache(maxsize=4096)
def distances(codes: str) -> tuple[int, ...]:
    """From each state ahead of a segment (not the last) to each state behind it, row by row of 4 x 4."""
    out = []
    for entry in range(4):
        for to in range(4):
            if to in (USER, ASSISTANT):
                out.append(auction(codes, entry, tuple(0 if x == to else FAR for x in range(4)), last=False)[0])
            elif to == entry:
                out.append(DELETE * len(codes))
            elif to == SYSTEM and entry == START and set(codes) & set("sS"):
                out.append(DELETE * (len(codes) - 1) + int("s" not in codes))
            else:
                out.append(FAR)
    return tuple(out)


def edits(path: list[tuple[str, int]], rows: int) -> list[str]:
    """What becomes of each row: 'u' or 'a' for each turn inserted ahead of it, then K, D, or U, A for a new role; the last row has later inserts too."""
    out, now = [], ""
    for letter, state in path:
        name = "user" if state == USER else "assistant"
        if letter == "I":
            now += name[0]
        else:
            out.append(now + (name[0].upper() if letter == "R" else letter))
            now = ""
    out[-1] += now
    assert len(out) == rows
    return out


def audit(row: str) -> str:
    """The letters of a row's edits."""
    return row.translate(str.maketrans("uaUA", "IIRR"))


@lru_cache(maxsize=1 << 14)
def _traced(codes: str, entry: int, exits: tuple[int, ...], last: bool) -> tuple[int, int, list[str]]:
    """(cost inside the segment, state behind it, edits of its rows)."""
    _, path = auction(codes, entry, exits, last)
    rows = edits(path, len(codes))
    cost = sum({"I": INSERT, "D": DELETE, "K": KEEP, "R": REROLE}[x] for r in rows for x in audit(r))
    cost += sum(c.isupper() and not any(x == "D" for x in r) for c, r in zip(codes, rows, strict=True))
    return cost, path[-1][1], rows


def _mapped(df: DataFrame, step: Callable[[dict], dict], schema: StructType) -> DataFrame:
    """``step`` over each row of small rows."""
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([step(r) for r in batch.to_pylist()], schema=kinds)

    return df.mapInArrow(run, schema)


def _streamed(df: DataFrame, order: list, start: Callable[[], dict], step: Callable[[dict, dict], dict | None], end: Callable[[dict], dict] | None, schema: StructType) -> DataFrame:
    """Rows by conversation in an order: ``step`` sees a state and a row and may give a row, ``end`` gives one for each conversation.

    Only the state is held, whatever the conversation's length.
    """
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != now:
                    if state is not None and end:
                        out.append({"conv_id": now} | end(state))
                    state, now = start(), r["conv_id"]
                if (made := step(state, r)) is not None:
                    out.append({"conv_id": now} | made)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if state is not None and end:
            yield pa.RecordBatch.from_pylist([{"conv_id": now} | end(state)], schema=kinds)

    return df.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order).mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage, which the row's key decides; null roles and texts are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where(F.col("kind") != 0)
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), "kind")
    again = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1).cast("int"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(again).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) and pos, which orders them: by conv_id, turn (nulls first), then role and the text's SHA-256.

    A range partitioning spreads a conversation of any length over many tasks,
    rows that repeat each other too.
    """
    spread = rows.withColumn("id", F.sha2("text", 256)).withColumn("salt", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "id", "salt")]
    spread = spread.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return settle(spread.select("conv_id", "turn", "role", "text", F.unhex(F.substring("id", 1, 32)).alias("id"), F.monotonically_increasing_id().alias("pos")), "ordered-turns")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, pos, letter (the role's, or x), fault (blank, duplicate, truncated or null) of ordered turns.

    A row's first fault counts: no character but spaces, role and text of an
    earlier row of the conversation, or no stop at its end.
    """
    many = turns.groupBy("conv_id", "role", "id").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    first = settle(many.select("pos"), "first-turns")
    rows = turns.select(
        "conv_id", "turn", "pos",
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x").alias("letter"),
        (~F.col("text").rlike(rf"[^{SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("open"),
    )
    rows = rows.join(first.withColumn("first", F.lit(True)), "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    return rows.select("conv_id", "turn", "pos", "letter", fault.alias("fault"))


def _met(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that lets null identifiers meet; the columns of ``a``, then the others of ``b``."""
    a, b = a.alias("a"), b.alias("b")
    cond = F.lit(True)
    for c in on:
        cond &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    more = [] if how == "left_semi" else [F.col(f"b.{c}") for c in b.columns if c not in on]
    return a.join(b, cond, how).select("a.*", *more)


def _ends(segments: DataFrame) -> DataFrame:
    """conv_id, seg, entry (the state ahead), exits (prices of the states behind), last of each segment (conv_id, seg, codes) of long conversations."""
    key = segments.schema["conv_id"]
    longs = ArrayType(LongType())
    base = StructType([key]).add("seg", LongType())
    reduced = _mapped(segments.select("conv_id", "seg", "codes"), lambda r: r | {"between": list(distances(r["codes"]))}, StructType([*base.fields, StructField("codes", StringType()), StructField("between", longs)]))

    def price(state: dict, r: dict) -> dict:
        last = "now" not in state
        now = state.get("now", list(BEHIND))
        state["now"] = [min(min(r["between"][4 * a + b] + now[b] for b in range(4)), FAR) for a in range(4)]
        return {"seg": r["seg"], "codes": r["codes"], "exits": list(FINAL) if last else now, "last": int(last)}

    known = StructType([*base.fields, StructField("codes", StringType()), StructField("exits", longs), StructField("last", LongType())])
    priced = settle(_streamed(reduced, [F.col("seg").desc()], dict, price, None, known), "prices")

    def leave(r: dict) -> dict:
        return r | {"leaves": [_traced(r["codes"], e, tuple(r["exits"]), bool(r["last"]))[1] for e in range(4)]}

    def enter(state: dict, r: dict) -> dict:
        entry = state.get("now", START)
        state["now"] = r["leaves"][entry]
        return {"seg": r["seg"], "exits": r["exits"], "last": r["last"], "entry": entry}

    left = _mapped(priced, leave, StructType([*known.fields, StructField("leaves", longs)]))
    found = StructType([*base.fields, StructField("exits", longs), StructField("last", LongType()), StructField("entry", LongType())])
    return settle(_streamed(left, [F.col("seg").asc()], dict, enter, None, found), "entries")


def planned(marked: DataFrame) -> DataFrame:
    """pos, edit of every row of ``faults``: what the cheapest repair of its conversation does with it (see ``edits``)."""
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("letter")).otherwise(F.col("letter"))
    rows = marked.select("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("seg"), F.struct("pos", code.alias("code")).alias("x"))
    segments = rows.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    segments = settle(segments.select("conv_id", "seg", F.col("xs.pos").alias("pos"), F.array_join("xs.code", "").alias("codes")), "segments")
    several = settle(segments.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("conv_id"), "long-conversations")
    ends = _ends(_met(segments, small(several), ["conv_id"], "left_semi"))
    each = _met(segments, small(ends), ["conv_id", "seg"], "left")
    schema = StructType([StructField("pos", ArrayType(LongType())), StructField("edit", ArrayType(StringType()))])

    def trace(r: dict) -> dict:
        alone = r["entry"] is None
        _, _, rows = _traced(r["codes"], START if alone else r["entry"], FINAL if alone else tuple(r["exits"]), alone or bool(r["last"]))
        return {"pos": r["pos"], "edit": rows}

    found = _mapped(each.select("pos", "codes", "entry", "exits", "last"), trace, schema)
    return found.select(F.explode(F.arrays_zip("pos", "edit")).alias("x")).select("x.*")


def _turns_of(edit: str, role: str, text: str) -> list[str]:
    """``role:text`` of the turns that a row becomes."""
    out = []
    for x in edit:
        if x in "ua":
            out.append("user:" if x == "u" else "assistant:")
        elif x != "D":
            out.append(f"{role if x == 'K' else 'user' if x == 'U' else 'assistant'}:{text}")
    return out


def _told(state: dict, r: dict) -> None:
    """Takes a row with its edit into the state of its conversation."""
    if r["turn"] is not None:
        state["low"] = r["turn"] if state["low"] is None else state["low"]
        state["turns"] += r["turn"] != state["high"]
        state["high"] = r["turn"]
    if r["fault"]:
        state[r["fault"]] += 1
    if state["before"] is not None:
        state["illegal"] += state["before"] + r["letter"] not in GOOD
    state["before"] = r["letter"]
    done = audit(r["edit"])
    state["audit"].append(done)
    state["cost"] += INSERT * done.count("I") + REROLE * done.count("R") + DELETE * done.count("D") + (r["fault"] == "truncated" and "D" not in done)
    for turn in _turns_of(r["edit"], r["role"], r["text"]):
        state["hash"].update(b"\n" * state["some"] + turn.encode())
        state["some"] = True


def _begun() -> dict:
    return {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "before": None, "audit": [], "some": False, "hash": hashlib.sha256()}


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _told_all(state: dict) -> dict:
    gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
    return {"gaps": gaps, **{c: state[c] for c in COUNTS[1:]}, "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()}


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, role, text, letter, fault, edit of the rows conv_id, turn, role, text (none of the last two null).

    Rows of one turn are ordered by role, then by the SHA-256 of their text.
    """
    turns = ordered(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    marked = settle(faults(turns), "faults")
    joined = turns.select("pos", "role", "text").join(marked, "pos").join(planned(marked), "pos")
    return joined.select("conv_id", "turn", "pos", "role", "text", "letter", "fault", "edit")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text): its faults and its cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, as the module tells; ``rows`` are the conversations' rows as
    they are now, if they differ. A null conv_id is a conversation too, null turns
    come first, null roles and texts are one space; rows that repeat each other
    are duplicates. A conversation without rows has zeros, an empty audit and the
    hash of an empty text. Very long conversations are repaired in segments, very
    long texts only hashed; an empty table gives an empty one. Other columns are
    ignored.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    now = repaired_turns((conversations if rows is None else rows).select("conv_id", "turn", space("role"), space("text")))
    schema = StructType([conversations.schema["conv_id"], *[StructField(c, LongType()) for c in COUNTS]]).add("audit", StringType()).add("repaired_sha256", StringType())
    found = _streamed(now, [F.col("pos").asc()], _begun, _told, _told_all, schema)
    every = conversations.select("conv_id").distinct()
    out = _met(every, found, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(rows, damaged(rows))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
"""No SQL: DuckDB has no CRC-32, which the damage needs; tests compare with an enumeration of all edits."""
