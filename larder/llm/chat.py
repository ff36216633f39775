"""Chat formatting: a hidden Markov model over transcript lines recovers who speaks, then turns are rendered one way."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from larder.llm.quality import remainder
from larder.llm.shared import settle, small, table

ROLES = ["system", "user", "assistant"]
STATES = [f"{p}{r}" for r in range(len(ROLES)) for p in "BI"]
"""B0: the first line of a turn of role 0; I0: a further line of it; and so on."""
_NAMES = {"s": "system|sys|instructions?", "u": "user|human|customer|prompt|question|q", "a": "assistant|ai|bot|agent|answer|response|a"}
_AFTER = r"\x20?[:|>\]]"
MARKERS = {k: rf"(?i)^\W{{0,4}}(?:{names}){_AFTER}" for k, names in _NAMES.items()} | {"o": rf"^\W{{0,4}}\w{{1,16}}{_AFTER}"}
"""Speaker markers at a line's start, first match; 'o' is a marker of an unknown speaker."""
LETTERS = ["s", "u", "a"]
"""The marker of each role."""
STRIP = rf"(?i)^\W{{0,4}}(?:{'|'.join(_NAMES.values())}){_AFTER}[:|>\]]? ?"
UNSEEN = 0.01
"""Count of a symbol that a state has not been seen with: little, as a marker of another role says more than a rare start."""
BLOCK = 64
"""Turns of a conversation that one task decodes at a time; a conversation is decoded as a whole."""


def observe(lines: Column, opens: Column | None = None) -> Column:
    """For each line of an array a symbol: its marker, whether a blank line stands before it, how it begins, its length.

    Blank lines have the symbol '-'. A transcript begins as after a blank line; for
    a further part of one, ``opens`` says whether the line before it was blank
    (null: there is none).
    """
    begins_open = F.lit(True) if opens is None else F.coalesce(opens, F.lit(True))

    def symbol(line: Column, i: Column) -> Column:
        marker = F.lit("n")
        for name, pattern in reversed(MARKERS.items()):
            marker = F.when(line.rlike(pattern), name).otherwise(marker)
        before = F.when(F.when(i == 0, begins_open).otherwise(F.trim(F.get(lines, i - 1)) == ""), "g").otherwise("h")
        begins = F.when(line.rlike(r"^\W*\p{Lu}"), "U").otherwise("l")
        long = F.when(F.char_length(line) > 80, "L").otherwise("s")
        return F.when(F.trim(line) == "", "-").otherwise(F.concat(marker, before, begins, long))

    return F.transform(lines, symbol)


def train(labelled: DataFrame) -> dict:
    """Log probabilities of starts, steps and symbols from rows of obs, states (arrays of equal length).

    Counts cover all rows; UNSEEN is added to those of the symbols seen and one
    unseen, one to those of starts and steps.
    """
    pairs = labelled.select(F.explode(F.arrays_zip(F.col("states").alias("state"), F.col("obs").alias("symbol"))).alias("x")).select("x.*")
    emitted = {(r["state"], r["symbol"]): r["n"] for r in pairs.groupBy("state", "symbol").agg(F.count("*").alias("n")).collect()}
    n = F.size("states")
    steps = labelled.where(n > 1).select(
        F.explode(F.arrays_zip(F.slice("states", 1, n - 1).alias("a"), F.slice("states", F.lit(2), n - 1).alias("b"))).alias("x")
    ).select("x.*")
    moved = {(r["a"], r["b"]): r["n"] for r in steps.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    begun = {r["s"]: r["n"] for r in labelled.where(n > 0).select(F.element_at("states", 1).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    symbols = sorted({s for _, s in emitted})

    def logs(counts: dict, keys: list, add: float = 1) -> dict:
        total = sum(counts.get(k, 0) for k in keys) + add * len(keys)
        return {k: math.log((counts.get(k, 0) + add) / total) for k in keys}

    return {
        "start": [logs(begun, STATES)[s] for s in STATES],
        "step": [[logs({b: moved.get((a, b), 0) for b in STATES}, STATES)[b] for b in STATES] for a in STATES],
        "emit": [logs({x: emitted.get((s, x), 0) for x in symbols}, [*symbols, ""], UNSEEN) for s in STATES],
    }


def emission(model: dict, x: str) -> list[float]:
    """The log probability of a symbol in each state."""
    return [e.get(x, e[""]) for e in model["emit"]]


def viterbi(symbols: list[str], model: dict, entry: int | None = None, last: int | None = None) -> list[int]:
    """The most probable states of a transcript; of equal ones the first by number.

    ``entry`` is the state before its first line, ``last`` that of its last line,
    where they are known.
    """
    if not symbols:
        return []
    step, n = model["step"], len(STATES)
    first = emission(model, symbols[0])
    now = [(model["start"][s] if entry is None else step[entry][s]) + first[s] for s in range(n)]
    back = []
    for x in symbols[1:]:
        seen = emission(model, x)
        came = [max(range(n), key=lambda a, b=b: now[a] + step[a][b]) for b in range(n)]
        now = [now[came[b]] + step[came[b]][b] + seen[b] for b in range(n)]
        back.append(came)
    path = [max(range(n), key=now.__getitem__) if last is None else last]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def recover_states(transcripts: DataFrame, model: dict) -> DataFrame:
    """``transcripts`` (with obs; entry and last where parts are decoded with their neighbours) and the column found: the state of each line."""
    schema = StructType([*transcripts.schema.fields, StructField("found", ArrayType(StringType()))])
    known = "entry" in transcripts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(batch.column("entry").to_pylist(), batch.column("last").to_pylist(), strict=True) if known else [(None, None)] * batch.num_rows
            found = [[STATES[s] for s in viterbi(obs or [], model, *e)] for obs, e in zip(batch.column("obs").to_pylist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "found"])

    return transcripts.mapInArrow(run, schema)


def _passage(symbols: list[str], model: dict) -> list[float]:
    """For each state before a part, and for its start, the best log probability of each state of its last line."""
    step, start = np.array(model["step"]), np.array(model["start"])
    emit = [np.array(emission(model, x)) for x in symbols]
    best = np.vstack([step, start]) + emit[0]
    for e in emit[1:]:
        best = (best[:, :, None] + step).max(1) + e
    return best.ravel().tolist()


def _chain(parts: list[list[float]]) -> list[tuple[int | None, int]]:
    """(state before, last state) of each part of the most probable path through all parts."""
    n = len(STATES)
    now, back = np.array(parts[0]).reshape(n + 1, n)[n], []
    for part in parts[1:]:
        each = now[:, None] + np.array(part).reshape(n + 1, n)[:n]
        back.append(each.argmax(0))
        now = each.max(0)
    last = [int(now.argmax())]
    for came in reversed(back):
        last.append(int(came[last[-1]]))
    last.reverse()
    return [(None, last[0]), *zip(last[:-1], last[1:], strict=True)]


def join_parts(parts: DataFrame, model: dict) -> DataFrame:
    """conv_id, block, entry, last of conversations in several parts (conv_id, block, obs), decoded as one sequence each.

    A part is reduced to the best log probability from any state before it to any
    of its last line, 42 numbers whatever its length. What meets by conversation
    is one such row for BLOCK turns; then every part can be decoded apart.
    """

    def reduce_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [_passage(obs, model) for obs in batch.column("obs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(best, pa.list_(pa.float64()))], ["conv_id", "block", "best"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [_chain([p["best"] for p in parts]) for parts in batch.column("parts").to_pylist()]
            kind = pa.list_(pa.struct([("entry", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([[{"entry": a, "last": b} for a, b in e] for e in ends], kind)], ["conv_id", "blocks", "ends"])

    key = parts.select("conv_id", "block").schema
    reduced = parts.where(F.size("obs") > 0).select("conv_id", "block", "obs").mapInArrow(reduce_part, StructType([*key.fields, StructField("best", ArrayType(DoubleType()))]))
    whole = reduced.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "best"))).alias("parts")).select("conv_id", F.col("parts.block").alias("blocks"), "parts")
    ends = StructType([*whole.select("conv_id", "blocks").schema.fields, StructField("ends", ArrayType(StructType([StructField("entry", IntegerType()), StructField("last", IntegerType())])))])
    found = whole.mapInArrow(chain, ends).select("conv_id", F.explode(F.arrays_zip("blocks", "ends")).alias("x"))
    return found.select("conv_id", F.col("x.blocks").alias("block"), "x.ends.entry", "x.ends.last")


def turns(lines: Column, states: Column, obs: Column) -> Column:
    """Array of role, text: runs of lines from one B state to the next; a first I state opens a turn too.

    A marker is taken off only where it stands in a B line and names that line's role.
    """
    n = F.size(lines)
    role = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (str(i), r)])
    letter = F.create_map(*[F.lit(x) for i, m in enumerate(LETTERS) for x in (f"B{i}", m)])
    marked = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.struct(
            i.alias("i"), F.coalesce(F.get(states, i - 1), F.lit("I1")).alias("s"), F.coalesce(F.get(lines, i - 1), F.lit("")).alias("line"),
            F.substring(F.coalesce(F.get(obs, i - 1), F.lit("-")), 1, 1).alias("marker"),
        ),
    )
    opens = F.filter(marked, lambda m: m["s"].startswith("B") | (m["i"] == 1))
    at = F.transform(opens, lambda m: m["i"])
    first = lambda m: F.when(F.element_at(letter, m["s"]) == m["marker"], F.regexp_replace(m["line"], STRIP, "")).otherwise(m["line"])
    return F.when(n < 1, F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.transform(
            opens,
            lambda m, k: F.struct(
                F.element_at(role, F.substring(m["s"], 2, 1)).alias("role"),
                F.trim(
                    F.concat_ws("\n", F.array(first(m)), F.slice(lines, m["i"] + 1, F.coalesce(F.get(at, k + 1), n + 1) - m["i"] - 1)),
                    F.lit(" \n\t"),
                ).alias("text"),
            ),
        )
    )


def escaped(text: Column) -> Column:
    """``text`` with a backslash before each backslash and each '<|', so that no turn can write a mark of the rendering."""
    return F.regexp_replace(text, r"\\|<\|", r"\\$0")


def render(found: Column) -> Column:
    """Turns as one text: a line with the role, the turn's text (escaped), an end mark."""
    return F.array_join(F.transform(found, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), escaped(t["text"]), F.lit("\n<|end|>"))), "\n")


def format_transcripts(transcripts: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``transcripts`` with turns (array of role, text) and canonical (their rendering); columns of these names are replaced.

    A null or empty text has no turns. Very long transcripts are read whole; the
    decoder keeps one row of back pointers for each line. Repeated rows get equal
    results, an empty table an empty one. Where the columns entry and last (state
    before the text and state of its last line) are given, decoding keeps to them,
    and ``opens`` beside them says whether the line before the text was blank.
    """
    kept = [c for c in transcripts.columns if c.lower() not in ("turns", "canonical")]
    ends = [c for c in ("entry", "last") if "entry" in kept and "last" in kept]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    rows = transcripts.select(F.struct(*kept).alias("row"), lines.alias("lines"), *ends)
    opens = F.col("row.opens") if "opens" in kept and ends else None
    seen = recover_states(rows.withColumn("obs", observe(F.col("lines"), opens)), model)
    seen = seen.withColumn("turns", turns(F.col("lines"), F.col("found"), F.col("obs")))
    return seen.select("row.*", "found", "turns", render(F.col("turns")).alias("canonical"))


def raw_transcripts(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, text, states, truth: the turns of a conversation as people paste them.

    The speaker markers follow a style picked by the conversation; one turn in
    ten has lost its marker. ``states`` is the truth for each line, ``truth`` the
    turns. Repeats of a row are one turn; null texts are empty, null turns come
    first, and roles other than the three count as 'user'. Each run of ``block``
    turns is a row, a part of the conversation's transcript.
    """
    known = F.when(F.col("role").isin(ROLES), F.col("role")).otherwise("user")
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = conversations.select(
        "conv_id", turn.alias("turn"), known.alias("role"),
        F.trim(F.coalesce("text", F.lit("")), F.lit(" \n\t")).alias("said"),
    ).distinct()
    style = F.pmod(F.shiftright(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), 8), F.lit(4))
    names = [("System: ", "User: ", "Assistant: "), ("### System: ", "### Human: ", "### AI: "), ("<|system|> ", "<|user|> ", "<|assistant|> "), ("Instructions: ", "Q: ", "A: ")]
    marker = F.lit("")
    for s, by_role in enumerate(names):
        for r, name in zip(ROLES, by_role, strict=True):
            marker = F.when((style == s) & (F.col("role") == r), name).otherwise(marker)
    lost = F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), F.lit(10)) == 0
    lines = F.split(F.concat(F.when(lost, "").otherwise(marker), F.col("said")), "\n")
    r = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    gap = F.when(style <= 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    rest = F.concat(F.lit("I"), r.cast("string"))
    states = F.concat(
        F.array(F.concat(F.lit("B"), r.cast("string"))), F.array_repeat(rest, F.size(lines) - 1 + F.size(gap))
    )
    one = F.struct("turn", "role", "said", F.concat(lines, gap).alias("lines"), states.alias("states"))
    blocks = rows.withColumn("block", F.floor(F.col("turn") / block)).select("conv_id", "block", one.alias("one"))
    every = blocks.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return every.select(
        "conv_id",
        "block",
        F.array_join(F.flatten("all.lines"), "\n").alias("text"),
        F.flatten("all.states").alias("states"),
        F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["said"].alias("text"))).alias("truth"),
    )


def decode_conversations(pasted: DataFrame, model: dict) -> DataFrame:
    """``format_transcripts`` of rows conv_id, block, text; the parts of a conversation are decoded as one sequence."""
    several = pasted.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("conv_id")
    several = small(settle(several, "long-conversations")).alias("s")
    long = pasted.alias("o").join(several, F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")), "left_semi")
    blank = F.trim(F.element_at(F.split("text", "\n"), -1)) == ""
    follows = F.lag("blank").over(Window.partitionBy("conv_id").orderBy("block"))
    opens = small(settle(long.select("conv_id", "block", blank.alias("blank")).select("conv_id", "block", follows.alias("opens")), "starts-of-parts"))

    def with_part(df: DataFrame, parts: DataFrame) -> DataFrame:
        met = F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("p.block") == F.col("e.block"))
        return df.alias("p").join(parts.alias("e"), met, "left").select("p.*", *[f"e.{c}" for c in parts.columns if c not in ("conv_id", "block")])

    obs = with_part(long, opens).select("conv_id", "block", observe(F.split("text", "\n"), F.col("opens")).alias("obs"))
    ends = small(settle(join_parts(obs, model), "ends-of-parts"))
    return format_transcripts(with_part(with_part(pasted, opens), ends), model)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation pasted as text, parsed and rendered; the model learns from three quarters of them."""
    pasted = settle(raw_transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    held = remainder("conv_id", 4) == 2
    known = pasted.where(~held).select("states", observe(F.split("text", "\n")).alias("obs"))
    found = decode_conversations(pasted, train(known))
    same = F.size(
        F.filter(F.arrays_zip("states", "found"), lambda x: F.substring(x["states"], 2, 1) == F.substring(x["found"], 2, 1))
    )
    return found.select(
        "conv_id",
        "block",
        held.alias("held_out"),
        F.size("found").alias("n_lines"),
        same.alias("n_right"),
        F.size("truth").alias("n_turns"),
        F.array_join("turns.role", ",").alias("roles"),
        F.sha2("canonical", 256).alias("canonical_sha256"),
        (F.col("canonical") == render(F.col("truth"))).alias("exact"),
    )


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLE_SQL: dict[str, str] = {}
