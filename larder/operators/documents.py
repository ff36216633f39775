"""Strict checks of JSON documents in bulk: every fault of a document as 'path: message'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.functions.text import MONTH_KEY, SNAKE_KEY, UUID
from larder.operators.rules import once
from larder.sources.store import settle

COST = r"^\d{1,6}\.\d{4}\z"
CHILD_REASONS = sorted(r for r, who in fixed.FAILURE_CLAIMANTS.items() if who != "parent")


def _get(path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col("v"), path, kind)


def _type(path: str) -> Column:
    """The raw JSON type: a plain cast would take true for 1 and '3' for 3."""
    return F.schema_of_variant(_get(path))


def _text(path: str) -> Column:
    return F.when(_type(path) == "STRING", _get(path, "string"))


def issue(path: str, good: Column, message: str) -> Column:
    return F.when(~F.coalesce(good, F.lit(False)), f"{path}: {message}")


def whole(path: str, least: int) -> Column:
    """A number equal to its floor, 3.0 included, but no boolean and no string."""
    n = _get(path, "double")
    return _type(path).rlike("^(BIGINT|INT|DECIMAL|DOUBLE)") & (n == F.floor(n)) & (n >= least)


def non_empty(path: str) -> Column:
    return F.length(_text(path)) > 0


def nullable(path: str) -> Column:
    return (_type(path) == "VOID") | non_empty(path)


def matches(path: str, pattern: str) -> Column:
    return _text(path).rlike(pattern)


def one_of(path: str, values: list[str]) -> Column:
    return _text(path).isin(values)


def is_object(path: str) -> Column:
    return _type(path).startswith("OBJECT<")


def no_others(path: str, allowed: list[str]) -> Column:
    """An object at ``path`` has no field beyond ``allowed``."""
    keys = F.json_object_keys(F.to_json(_get(path)))
    return F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0


def check(docs: DataFrame, issues) -> DataFrame:
    """``docs`` (with text) and issues (array) and message (joined); text that is no JSON object has one issue."""
    rows = once(docs, v=F.try_parse_json("text"))
    rows = once(rows, issues=F.when(F.coalesce(is_object("$"), F.lit(False)), F.array_compact(F.array(*issues()))).otherwise(F.array(F.lit("$: expected a JSON object"))))
    return rows.drop("v").withColumn("message", F.array_join("issues", "; "))


def check_run(docs: DataFrame) -> DataFrame:
    """The run manifest."""
    def issues() -> list[Column]:
        counts = F.from_json(F.to_json(_get("$.report.monthlyCounts")), "map<string,string>")
        kinds = F.transform(F.map_keys(counts), lambda k: F.concat(k, F.lit("")))
        typed = ~F.coalesce(_type("$.report.monthlyCounts").rlike("STRING|BOOLEAN|VOID|ARRAY"), F.lit(True))
        good = is_object("$.report.monthlyCounts") & (F.size(kinds) > 0) & typed & F.forall(kinds, lambda k: k.rlike(MONTH_KEY)) & F.forall(F.map_values(counts), lambda n: n.rlike(r"^\d+(\.0+)?\z"))
        return [
            issue("$", no_others("$", ["analysisAttemptId", "report"]), "unknown field"),
            issue("analysisAttemptId", matches("$.analysisAttemptId", UUID), "expected a UUID"),
            issue("report", is_object("$.report") & no_others("$.report", ["name", "siteName", "countsBasis", "unitSystem", "monthlyCounts"]), "expected an object of known fields"),
            issue("report.name", nullable("$.report.name"), "expected text or null"),
            issue("report.siteName", nullable("$.report.siteName"), "expected text or null"),
            issue("report.countsBasis", one_of("$.report.countsBasis", fixed.COUNTS_BASES), "not in the vocabulary"),
            issue("report.unitSystem", one_of("$.report.unitSystem", fixed.UNIT_SYSTEMS), "not in the vocabulary"),
            issue("report.monthlyCounts", good, "expected whole numbers by month"),
        ]

    return check(docs, issues)


def check_progress(docs: DataFrame) -> DataFrame:
    """J2."""
    return check(docs, lambda: [issue("$", no_others("$", ["sequence"]), "unknown field"), issue("sequence", whole("$.sequence", 1), "expected a whole number of 1 or more")])


def check_result(docs: DataFrame) -> DataFrame:
    """J3."""
    def issues() -> list[Column]:
        charts = F.from_json(F.to_json(_get("$.charts")), "array<string>")
        typed = _type("$.charts").isin("ARRAY<STRING>", "ARRAY<VOID>")
        good = typed & (F.size(charts) == F.size(F.array_distinct(charts))) & F.forall(charts, lambda c: F.coalesce(c.rlike(SNAKE_KEY), F.lit(False)))
        return [
            issue("$", no_others("$", ["analysisAttemptId", "charts", "ai", "resultMetadata"]), "unknown field"),
            issue("analysisAttemptId", matches("$.analysisAttemptId", UUID), "expected a UUID"),
            issue("charts", good, "expected distinct snake_case keys"),
            issue("ai", is_object("$.ai") & no_others("$.ai", ["model", "inputTokens", "outputTokens", "costUsd", "metadata"]), "expected an object of known fields"),
            issue("ai.model", non_empty("$.ai.model"), "expected text"),
            issue("ai.inputTokens", whole("$.ai.inputTokens", 0), "expected a whole number"),
            issue("ai.outputTokens", whole("$.ai.outputTokens", 0), "expected a whole number"),
            issue("ai.costUsd", matches("$.ai.costUsd", COST), "expected a cost with four places"),
            issue("ai.metadata", is_object("$.ai.metadata"), "expected a JSON object"),
            issue("resultMetadata", is_object("$.resultMetadata"), "expected a JSON object"),
        ]

    return check(docs, issues)


def check_failure(docs: DataFrame) -> DataFrame:
    """Only reasons that the child may claim."""
    return check(
        docs,
        lambda: [
            issue("$", no_others("$", ["reason", "detail", "traceback"]), "unknown field"),
            issue("reason", one_of("$.reason", CHILD_REASONS), "not a reason the child may claim"),
            issue("detail", non_empty("$.detail"), "expected text"),
            issue("traceback", nullable("$.traceback"), "expected text or null"),
        ],
    )


def class_reasons(classes: DataFrame, named: dict[str, str] = fixed.CHILD_ERRORS) -> DataFrame:
    """class, reason of every class of ``classes`` (class, parent; a row for each parent) that is one of the named ones or below it.

    As with ``isinstance``: of several named ancestors the first in the order of
    ``named`` decides, however far it is. Each round hands the best name on to the
    children; rounds follow the depth of the hierarchy, and a cycle ends too.
    """
    spark = classes.sparkSession
    order = spark.createDataFrame([(c, i) for i, c in enumerate(named)], "class string, best int")
    edges = settle(classes.select("class", "parent").where("parent IS NOT NULL").distinct(), "classes")
    known = settle(order, "named-classes")
    while True:
        handed = edges.join(known.withColumnRenamed("class", "parent"), "parent").select("class", "best")
        now = settle(known.unionByName(handed).groupBy("class").agg(F.min("best").alias("best")), "named-classes")
        more = now.exceptAll(known).limit(1).count()
        known = now
        if not more:
            break
    return known.select("class", F.element_at(F.array(*map(F.lit, named.values())), F.col("best") + 1).alias("reason"))


def child_reasons(errors: DataFrame, classes: DataFrame) -> DataFrame:
    """``errors`` (class, message) with reason and detail: the failure that a child reports for an error of that class."""
    met = errors.join(class_reasons(classes), "class", "left")
    said = F.when(F.coalesce(F.length("message"), F.lit(0)) > 0, F.col("message")).otherwise(F.concat("class", F.lit("()")))
    return met.withColumns({"reason": F.coalesce("reason", F.lit("unknown")), "detail": said})


def run_manifest(rows: DataFrame) -> DataFrame:
    """Id, text - run documents from rows of id, uuid, name, site_name, counts_basis, unit_system, monthly_counts (map of month to count)."""
    report = F.struct(
        "name", F.col("site_name").alias("siteName"), F.col("counts_basis").alias("countsBasis"), F.col("unit_system").alias("unitSystem"), F.col("monthly_counts").alias("monthlyCounts"),
    )
    return rows.select("id", F.to_json(F.struct(F.col("uuid").alias("analysisAttemptId"), report.alias("report")), {"ignoreNullFields": "false"}).alias("text"))


def result_payload(rows: DataFrame) -> DataFrame:
    """Attempt, payload - result documents from columns, the cost as text with four places."""
    ai = F.struct(
        F.col("ai_model").alias("model"), F.col("ai_input_tokens").alias("inputTokens"), F.col("ai_output_tokens").alias("outputTokens"),
        F.col("ai_cost_usd").cast("decimal(10,4)").cast("string").alias("costUsd"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return rows.select("id", F.to_json(F.struct(F.col("uuid").alias("analysisAttemptId"), F.col("charts"), ai.alias("ai"), F.create_map().cast("map<string,string>").alias("resultMetadata"))).alias("text"))
