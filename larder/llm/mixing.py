"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.shared import documents, is_small, settle, small, unit_hash, unused

FACTORS = ["source", "lang", "topic"]
TOLERANCE = 1e-9
MOST_ROUNDS = 200
ROUNDS_A_JOB = 4
FEW_BYTES = 4 << 20
"""Cells up to so many counted bytes are raked several rounds a job; others one."""
ORACLE_ROUNDS = 24
"""Rounds of the SQL twin, which has no loop; enough for the tables at hand."""
BUDGET = 0.5
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}

TOPICS = [
    ("licence", "(?i)licen[cs]ed under|public license"),
    ("markup", "[$#%&*]{3}"),
    ("list", " [|] "),
    ("contact", "[0-9]{3}[-. ][0-9]{3,4}|@"),
]
"""Topic rules in order; a text that meets none is 'prose'."""


def topic_of(text: Column) -> Column:
    """The first topic whose pattern the text contains."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(TOPICS):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return F.coalesce(found, F.lit("prose"))


def tempered_targets(cells: DataFrame, power: dict[str, float]) -> dict[str, DataFrame]:
    """For each factor its values and target shares: the shares of tokens, to a power, normalised."""
    targets = {}
    for factor, p in power.items():
        marginal = cells.groupBy(factor).agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > 0)
        raised = settle(marginal.select(factor, F.pow(F.col("tokens").cast("double"), F.lit(p)).alias("raised")), f"raised-{factor}")
        total = raised.agg(F.sum("raised")).first()[0] or 1.0
        targets[factor] = raised.select(factor, (F.col("raised") / F.lit(float(total))).alias("target"))
    return targets


def _round(rows: DataFrame, names: list[str], few: bool) -> DataFrame:
    """One step for each factor; ``move`` is the largest relative change of a step, by cell.

    ``few``: sums come by windows within the one task that holds all cells, else
    they are aggregated before the shuffle and joined.
    """
    step = rows.withColumn("move", F.lit(0.0))
    for f in names:
        if few:
            met = step.withColumn("sum", F.sum("weight").over(Window.partitionBy(f)))
        else:
            sums = step.groupBy(F.col(f).alias("of")).agg(F.sum("weight").alias("sum"))
            met = step.join(sums, F.col(f).eqNullSafe(F.col("of")))
        scale = F.when(F.col("sum") > 0, F.col(f"target_{f}") / F.col("sum")).otherwise(0.0)
        moved = F.when((F.col("sum") > 0) & (F.col("weight") > 0), F.abs(scale - 1)).otherwise(0.0)
        step = met.withColumn("move", F.greatest("move", moved)).withColumn("weight", F.col("weight") * scale).select(*rows.columns)
    return step


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, most: int = MOST_ROUNDS, few_bytes: int = FEW_BYTES
) -> DataFrame:
    """``cells`` (factors, tokens) with the columns weight and missed, raked to each target in turn until all are met.

    Each cell carries the targets of its values; a value without one has target
    0, and so has its cells' weight. A step sums the weights by one factor and
    scales. Up to ``few_bytes`` a job does ROUNDS_A_JOB rounds, beyond it one;
    what a job leaves is written. Rounds end when no step scales by more than
    ``tolerance``, when they come no nearer (targets contradict the empty cells),
    or after ``most``: targets that can be met only in the limit, with a further
    cell at 0, are approached ever more slowly. ``missed`` says by how much the
    reached share of any of the cell's values differs from its target; it is 0,
    up to rounding, where targets were met. Targets of values that no cell has are
    in ``reached`` only.
    """
    rows, names = cells.withColumn("weight", F.col("tokens").cast("double")).withColumn("move", F.lit(0.0)), list(targets)
    for f, t in targets.items():
        rows = rows.join(t.select(f, F.col("target").alias(f"target_{f}")), f, "left")
    now = settle(rows.select(*cells.columns, "weight", "move", *[F.coalesce(f"target_{f}", F.lit(0.0)).alias(f"target_{f}") for f in names]), "raked")
    few, done, before = is_small(now, few_bytes), 0, float("inf")
    while done < most:
        n = min(ROUNDS_A_JOB if few else 1, most - done)
        step = now.coalesce(1) if few else now
        for _ in range(n):
            step = _round(step, names, few)
        now, done = settle(step, f"raked-{done}"), done + n
        moved = now.agg(F.max("move")).first()[0] or 0.0
        if moved <= tolerance or (done > 3 and moved > 0.999**n * before):
            break
        before = moved
    met = now.withColumn("missed", F.lit(0.0))
    for f in names:
        sums = now.groupBy(F.col(f).alias("of")).agg(F.sum("weight").alias("sum"))
        met = met.join(small(sums), F.col(f).eqNullSafe(F.col("of"))).withColumn("missed", F.greatest("missed", F.abs(F.col("sum") - F.col(f"target_{f}")))).drop("of", "sum")
    return met.select(*cells.columns, "weight", "missed")


def reached(raked: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """factor, value, target, reached: what share of the weights each value has."""
    parts = []
    for f, t in targets.items():
        now = raked.groupBy(f).agg(F.sum("weight").alias("reached"))
        parts.append(t.join(now, f, "left").select(F.lit(f).alias("factor"), F.col(f).alias("value"), "target", F.coalesce("reached", F.lit(0.0)).alias("reached")))
    return reduce(DataFrame.union, parts)


def calibrate(raked: DataFrame, budget: float) -> DataFrame:
    """The column probability: tokens drawn follow the weights, their expected sum is ``budget`` of all tokens.

    Probabilities over 1 are held at 1 and the rest scaled up until no further
    cell reaches 1; then the budget is spent, unless the cells that have weight
    hold less than it. Only sums reach the driver.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    total, held = raked.agg(F.sum("tokens"), F.sum("weight")).first()
    total = float(total or 0)
    scale, capped = (budget * total / held if held else 0.0), -1
    while held:
        full = ratio * scale >= 1
        now = raked.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, F.col("tokens"))).alias("placed"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if now["n"] == capped or not now["open"]:
            break
        capped = now["n"]
        scale = max(scale, (budget * total - float(now["placed"] or 0)) / now["open"])
    return raked.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(float(scale))))


def factors(topic: Column | None = None) -> list[Column]:
    """The cell of a row: source, lang and topic; nulls are the value ''."""
    text = F.coalesce("text", F.lit(""))
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    return [*given, (topic_of(text) if topic is None else topic).alias("topic")]


def cell_probabilities(rows: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """source, lang, topic, weight, missed, probability from rows of the three factors and tokens."""
    cells = settle(rows.groupBy(*FACTORS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = settle(rake(cells, targets or tempered_targets(cells, TEMPER)), "raked-cells")
    return small(settle(calibrate(raked, budget).select(*FACTORS, "weight", "missed", "probability"), "calibrated"))


def drawn(seed: str, probability: Column) -> Column:
    """Whether a row is drawn: a hash of (seed, doc_id) against its probability."""
    return unit_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) < probability


TOKENS = r"\S+"


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    topic: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """Every row with its cell, its calibrated probability and whether it is drawn.

    Returns doc_id, source, lang, topic, tokens, weight, missed, probability,
    sampled. ``missed``: how far any of the row's source, lang and topic stays from
    its target share, where targets cannot be met (see ``rake``).
    ``targets``: for each of source, lang and topic a table of the value and
    ``target`` (shares); by default the corpus's own shares, tempered. Tokens are
    runs of characters other than white space; a null text has none, and a row
    without tokens is drawn with its cell's probability. Null factors are a value
    of their own ('' in the result). Drawing hashes (seed, doc_id): repeated
    identifiers are drawn together. An empty table gives an empty result; other
    columns are ignored.

    Only sums by cell are shuffled; the number of cells is that of distinct
    (source, lang, topic), and they are broadcast only up to a counted size.
    """
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKENS)).cast("long").alias("tokens")
    rows = settle(docs.select("doc_id", *factors(topic), tokens), "mix-rows")
    found = cell_probabilities(rows, targets, budget)
    return rows.join(found, FACTORS).select(
        "doc_id", *FACTORS, "tokens", "weight", "missed", "probability", drawn(seed, F.col("probability")).alias("sampled")
    )


def sample(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: str = "mix"
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` draws, with all their columns, whatever their names."""
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKENS)).cast("long").alias("tokens")
    found = cell_probabilities(docs.select(*factors(), tokens), targets, budget)
    cell = unused(docs, "cell")
    chance = unused(docs, "probability")
    met = docs.withColumn(cell, F.struct(*factors())).join(
        found.select(F.struct(*FACTORS).alias(cell), F.col("probability").alias(chance)), cell
    )
    return met.where(drawn(seed, F.col(chance))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(documents(spark, sf_dir))
    return found.select("doc_id", *FACTORS, "tokens", *[F.round(c, 7).alias(c) for c in ("weight", "missed", "probability")], "sampled")


def _oracle() -> str:
    topic = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [f"""
WITH r AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE {topic} ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS tokens
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
c AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL)"""]
    for f, p in TEMPER.items():
        parts.append(
            f"t_{f} AS (SELECT {f}, x / sum(x) OVER () AS target FROM "
            f"(SELECT {f}, pow(CAST(sum(tokens) AS DOUBLE), {p}) AS x FROM c GROUP BY 1 HAVING sum(tokens) > 0))"
        )
    last, n = "(SELECT *, CAST(tokens AS DOUBLE) AS weight FROM c)", 0
    for _ in range(ORACLE_ROUNDS):
        for f in FACTORS:
            n += 1
            parts.append(
                f"s{n} AS MATERIALIZED (SELECT a.* EXCLUDE (weight, now, target), CASE WHEN now > 0 THEN weight * coalesce(target, 0) / now ELSE 0 END AS weight "
                f"FROM (SELECT *, sum(weight) OVER (PARTITION BY {f}) AS now FROM {last}) b LEFT JOIN t_{f} USING ({f})) ".replace("a.* EXCLUDE (weight, now, target)", "source, lang, topic, tokens")
            )
            last = f"s{n}"
    gaps = ", ".join(f"abs(sum(weight) OVER (PARTITION BY {f}) - coalesce(t_{f}.target, 0))" for f in FACTORS)
    joins = " ".join(f"LEFT JOIN t_{f} USING ({f})" for f in FACTORS)
    parts.append(f"e AS MATERIALIZED (SELECT source, lang, topic, tokens, weight, greatest({gaps}) AS missed FROM {last} {joins})")
    parts.append(
        f"""q AS MATERIALIZED (SELECT source, lang, topic, weight, missed, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio,
  sum(tokens) OVER () * {BUDGET} AS goal,
  coalesce(sum(tokens) OVER o, 0) AS placed, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open
FROM e WINDOW o AS (ORDER BY CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    )
    # The cells of the highest ratios are held at 1; the first that need not be gives the scale of the rest.
    parts.append("k AS (SELECT coalesce(max((goal - placed) / open) FILTER (WHERE ratio * (goal - placed) / open < 1 AND ratio > 0), 0) AS scale FROM q WHERE open > 0)")
    parts.append("p4 AS (SELECT source, lang, topic, weight, missed, least(1.0, ratio * scale) AS p FROM q, k)")
    u = "(CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496"
    return ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, r.tokens, round(weight, 7) AS weight, round(missed, 7) AS missed, round(p, 7) AS probability, {u} < p AS sampled
FROM r JOIN p4 USING (source, lang, topic)"""


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL = {"op5_mixing": _oracle()}
