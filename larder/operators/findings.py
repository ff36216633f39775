"""Folding row faults into a few readable problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.functions.text import group_digits, list_of, plural, trim
from larder.operators import rules
from larder.sources.store import settle


def row_findings(read: DataFrame, resolved: DataFrame) -> DataFrame:
    """upload, line, phase, ord, key, kind, fault, col, actual, expected, raw - one row for each fault."""

    def finding(when: Column, ord_: int, kind: Column | str, **more: Column) -> Column:
        fields = {
            "phase": F.lit(0), "ord": F.lit(ord_), "kind": F.lit(kind) if isinstance(kind, str) else kind,
            "fault": F.lit(None).cast("string"), "col": F.lit(None).cast("string"), "actual": F.lit(None).cast("int"),
            "expected": F.lit(None).cast("int"), "raw": F.lit(None).cast("string"),
        } | more
        return F.when(when, F.struct(*[v.alias(k) for k, v in fields.items()]))

    width = finding(F.col("wrong_width"), 0, "width", actual=F.col("actual").cast("int"), expected=F.col("expected").cast("int"))
    long_ = [finding(F.array_contains("too_long", c), i, "too-long", col=F.lit(c)) for i, c in enumerate(fixed.REQUIRED_COLUMNS)]
    formula = F.col("product_fault") == "formula"
    product = finding(
        F.col("product_fault").isNotNull(), 0, F.when(formula, "formula").otherwise("product"),
        fault=F.when(~formula, F.col("product_fault")), raw=F.col("product"),
    )
    weight = finding(F.col("weight_fault").isNotNull(), 1, "weight", fault=F.col("weight_fault"), raw=F.col("weight"))
    date = finding(F.col("date_fault").isNotNull(), 2, "date", fault=F.col("date_fault"), raw=F.col("date"))
    faults = read.where(~F.col("ok")).select("upload", "line", F.explode(F.array_compact(F.array(width, *long_, product, weight, date))).alias("f"))
    later = resolved.where(F.col("resolved_fault").isNotNull()).select(
        "upload", "line",
        finding(F.lit(True), 2, "resolved-date", phase=F.lit(1), fault=F.col("resolved_fault"), raw=F.col("date")).alias("f"),
    )
    found = faults.select("upload", "line", "f.*").unionByName(later.select("upload", "line", "f.*"))
    key = F.concat_ws("|", "kind", F.coalesce("fault", "col", F.col("actual").cast("string")))
    return found.withColumn("key", F.when(F.col("kind") == "formula", "formula").otherwise(key))


def group_findings(found: DataFrame) -> DataFrame:
    """One row per upload and key: n, ranges (first five), examples (first three), first_at, finding."""
    at = F.struct("phase", "line", "ord")
    groups = found.groupBy("upload", "key").agg(
        F.count("*").alias("n"), F.min(at).alias("first_at"),
        F.min_by(F.struct("kind", "fault", "col", "actual", "expected", "raw"), at).alias("finding"),
    )
    by_line = Window.partitionBy("upload", "key").orderBy("line")
    islands = found.withColumn("island", F.col("line") - F.row_number().over(by_line)).groupBy("upload", "key", "island").agg(
        F.min("line").alias("start"), F.max("line").alias("end")
    )
    kept = islands.withColumn("i", F.row_number().over(Window.partitionBy("upload", "key").orderBy("start"))).where(
        F.col("i") <= fixed.MAX_ROW_RANGES_REPORTED
    )
    ranges = kept.groupBy("upload", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    raws = found.where(F.col("raw").isNotNull() & (trim(F.col("raw")) != "")).groupBy("upload", "key", "raw").agg(F.min(F.struct("phase", "line", "ord")).alias("at"))
    raws = raws.withColumn("i", F.row_number().over(Window.partitionBy("upload", "key").orderBy("at", "raw"))).where(F.col("i") <= fixed.MAX_EXAMPLE_VALUES)
    examples = raws.groupBy("upload", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda x: x["raw"]).alias("examples"))
    return (
        groups.join(ranges.hint("merge"), ["upload", "key"]).join(examples.hint("merge"), ["upload", "key"], "left")
        .withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    )


def failing_rows(found: DataFrame) -> DataFrame:
    """upload, failing - rows with at least one finding."""
    return found.groupBy("upload").agg(F.count_distinct("line").alias("failing"))


def quote(raw: Column) -> Column:
    """flattened, trimmed, cut at 40 characters."""
    flat = trim(F.regexp_replace(raw, r"[\t\n\r]+", " "))
    cut = fixed.MAX_QUOTED_CHARS
    return F.concat(F.lit('"'), F.when(F.length(flat) > cut, F.concat(F.substring(flat, 1, cut), F.lit("…"))).otherwise(flat), F.lit('"'))


def format_rows(ranges: Column, n: Column, rows_read: Column) -> Column:
    """'row 15', '5 rows: 2–4, 8, 11 and 3 more', 'all 4,500 rows'."""
    named = F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"] + 1))
    text = F.array_join(
        F.transform(
            ranges,
            lambda r: F.when(r["end"] - r["start"] >= 2, F.concat(r["start"].cast("string"), F.lit("–"), r["end"].cast("string")))
            .when(r["end"] == r["start"], r["start"].cast("string"))
            .otherwise(F.concat(r["start"].cast("string"), F.lit(", "), r["end"].cast("string"))),
        ),
        ", ",
    )
    more = F.when(n > named, F.concat(F.lit(" and "), (n - named).cast("string"), F.lit(" more"))).otherwise("")
    return (
        F.when(n == rows_read, F.concat(F.lit("all "), group_digits(n), F.lit(" rows")))
        .when(n == 1, F.concat(F.lit("row "), F.element_at(ranges, 1)["start"].cast("string")))
        .otherwise(F.concat(group_digits(n), F.lit(" rows: "), text, more))
    )


def dictionary(spark) -> DataFrame:
    """The clause and advice of every kind and fault: a table of fixed size."""
    rows = [(k, f, f"The {k} {c}", a) for (k, f), (c, a) in fixed.CLAUSES.items()]
    rows += [("resolved-date", f, r, a) for k, f, r, a in rows if k == "date"]
    return spark.createDataFrame(rows, "kind string, fault string, rule string, advice string")


def word_problems(groups: DataFrame, rows_read: DataFrame) -> DataFrame:
    """Adds rule, advice, rows_text, quoted, rows_read."""
    words = F.broadcast(dictionary(groups.sparkSession))  # a few dozen rows
    flat = groups.select("*", F.col("finding.kind").alias("kind"), F.col("finding.fault").alias("fault"))
    met = flat.join(words, ["kind", "fault"], "left").join(rows_read.select("upload", "rows_read").hint("merge"), "upload")
    actual, expected = F.col("finding.actual"), F.col("finding.expected")
    rule = (
        F.when(F.col("kind") == "too-long", F.concat(F.lit("The "), F.col("finding.col"), F.lit(f" is over {fixed.MAX_FREE_TEXT_LENGTH} characters long")))
        .when(F.col("kind") == "formula", fixed.FORMULA_RULE)
        .when(F.col("kind") == "width", F.concat(F.lit("Has "), actual.cast("string"), F.lit(" "), plural(actual, "column"), F.lit(" where the header has "), expected.cast("string")))
        .otherwise(F.col("rule"))
    )
    return met.withColumns(
        {
            "rule": rule,
            "rows_text": format_rows(F.col("ranges"), F.col("n"), F.col("rows_read")),
            "quoted": F.array_distinct(F.transform("examples", quote)),
        }
    )


def order_problem(decided: DataFrame) -> DataFrame:
    """upload, order_fault, date_order_problem."""
    def cell(name: str) -> Column:
        return quote(F.col(f"{name}.date"))

    def line(name: str) -> Column:
        return F.col(f"{name}.line").cast("string")

    both = rules.both_readings(F.col("ambiguous.first"), F.col("ambiguous.second"), F.col("ambiguous.year"))
    contradictory = F.concat(
        F.lit("Your dates are written both ways: row "), line("day_first"), F.lit(" has "), cell("day_first"),
        F.lit(", which can only be day first, and row "), line("month_first"), F.lit(" has "), cell("month_first"),
        F.lit(f", which can only be month first. {fixed.ORDER_ADVICE}"),
    )
    unresolvable = F.concat(
        F.lit("Every date in that file could be read two ways — row "), line("ambiguous"), F.lit("'s "), cell("ambiguous"), F.lit(" is "),
        both["day_first"], F.lit(" or "), both["month_first"], F.lit(f". {fixed.ORDER_ADVICE}"),
    )
    text = F.when(F.col("order_fault") == "contradictory", contradictory).otherwise(unresolvable)
    return decided.where(F.col("order_fault").isNotNull()).select("upload", "order_fault", text.alias("date_order_problem"))


def reject(worded: DataFrame, failing: DataFrame, decided: DataFrame) -> DataFrame:
    """One row per rejected upload: reason, summary, problems, date_order_problem, detail.

    At most 20 problems are shown, in the order first reached; the date-order
    problem always takes one of the places.
    """
    ordered = order_problem(decided)
    per = decided.select("upload", "rows_read").join(failing.hint("merge"), "upload", "left").join(ordered.hint("merge"), "upload", "left")
    per = per.where(F.col("failing").isNotNull() | F.col("date_order_problem").isNotNull()).withColumn("failing", F.coalesce("failing", F.lit(0)))
    has = F.col("date_order_problem").isNotNull()
    rank = Window.partitionBy("upload").orderBy("first_at")
    listed = worded.select("upload", "first_at", "rule", "advice", "rows_text", "quoted").withColumn("i", F.row_number().over(rank))
    listed = listed.join(per.select("upload", has.cast("int").alias("taken")).hint("merge"), "upload")
    example = F.when(F.size("quoted") > 0, F.concat(F.lit(" For example "), list_of(F.col("quoted")), F.lit("."))).otherwise("")
    line = F.concat("rows_text", F.lit(": "), "rule", F.lit("."), example)
    shown = F.col("i") <= fixed.MAX_PROBLEMS_REPORTED - F.col("taken")
    packed = listed.groupBy("upload").agg(
        F.count("*").alias("kinds"),
        F.array_sort(F.collect_list(F.when(shown, F.struct("i", "rule", "advice", "rows_text", "quoted", line.alias("line"))))).alias("problems"),
    )
    met = per.join(packed.hint("merge"), "upload", "left").withColumns(
        {"kinds": F.coalesce("kinds", F.lit(0)), "n_shown": F.coalesce(F.size("problems"), F.lit(0))}
    )
    total = F.col("kinds") + has.cast("int")
    visible = F.col("n_shown") + has.cast("int")
    hidden = total - visible
    headline = F.concat(
        F.lit("We found problems in "), group_digits(F.col("failing")), F.lit(" of your "), group_digits(F.col("rows_read")), F.lit(" "), plural(F.col("rows_read"), "row"), F.lit("."),
    )
    note = F.when(hidden > 0, F.concat(F.lit(" Showing "), visible.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" things to fix."))).otherwise("")
    lines = F.when(F.col("n_shown") > 0, F.array_join(F.transform("problems", lambda p: p["line"]), "; "))
    detail = F.concat_ws("; ", "date_order_problem", lines, F.when(hidden > 0, F.concat(F.lit("and "), hidden.cast("string"), F.lit(" more"))))
    return met.select(
        "upload", F.lit("bad_rows").alias("reason"), F.concat(headline, note).alias("summary"),
        F.coalesce(F.transform("problems", lambda p: F.struct(p["rule"].alias("rule"), p["advice"].alias("advice"), p["rows_text"].alias("rows"), p["quoted"].alias("examples"))), F.array()).alias("problems"),
        "date_order_problem", detail.alias("detail"),
    )


def accept(judged: DataFrame) -> DataFrame:
    """The rows of uploads without a fault: upload, line, product, iso, weight."""
    return rules.resolved_rows(judged).where(~F.col("refused")).select(
        "upload", "line", F.col("product_value").alias("product"), F.col("resolved_iso").alias("iso"), F.col("weight_value").alias("weight")
    )


def months_of(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("upload").agg(F.array_sort(F.collect_set(F.substring("iso", 1, 7))).alias("months"))


def outcomes(judged: DataFrame, *keep: str) -> DataFrame:
    """One row per upload of ``judge``: refused, months of its accepted rows (none of a refused one), and columns to ``keep``, which are one value an upload."""
    month = F.when(F.col("ok") & ~F.col("refused"), F.substring("resolved_iso", 1, 7))
    return judged.groupBy("upload").agg(*[F.max(c).alias(c) for c in keep], F.max("refused").alias("refused"), F.collect_set(month).alias("months"))


def normalize(read: DataFrame, now: str) -> dict[str, DataFrame]:
    """Rows from ``read_cells`` to accepted rows and rejections (V17, V18 and all of F).

    The rows read are kept in the shared folder: every later step reads them.
    Returns decided, resolved, found, groups, worded, rejected, accepted, months.
    """
    read = settle(read, "read-cells")
    decided = settle(rules.decide_order(read), "date-orders")
    found = settle(row_findings(read, rules.late_faults(read, decided)), "row-findings")
    judged = rules.judge(read, now)
    groups = group_findings(found)
    worded = word_problems(groups, decided)
    rejected = reject(worded, failing_rows(found), decided)
    accepted = accept(judged)
    return {
        "decided": decided, "resolved": rules.resolved_rows(judged), "found": found, "groups": groups, "worded": worded,
        "rejected": rejected, "accepted": accepted, "months": months_of(accepted),
    }
