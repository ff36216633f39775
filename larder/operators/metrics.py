"""Usage, timing, cost and product metrics. Where no behaviour is given the definitions are this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LB_IN_KG = 0.45359237


def cumulative(df: DataFrame, at: str, unit: str = "month") -> DataFrame:
    """M1: period, n and the running total. One row for each period reaches the window."""
    per = df.groupBy(F.date_trunc(unit, at).alias("period")).agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))


def durations(attempts: DataFrame, shares: list[float]) -> DataFrame:
    """M2: per day of creation, exact percentiles of waiting, processing and total seconds."""
    sec = F.unix_timestamp
    rows = attempts.select(
        F.date_trunc("day", "created_at").alias("day"), (sec("claimed_at") - sec("created_at")).alias("wait"),
        (sec("finished_at") - sec("claimed_at")).alias("run"), (sec("finished_at") - sec("created_at")).alias("total"),
    )
    return rows.groupBy("day").agg(*[F.percentile(c, p).alias(f"{c}_p{int(p * 100)}") for c in ("wait", "run", "total") for p in shares])


def costs(attempts: DataFrame, reports: DataFrame) -> DataFrame:
    """M3: rollup of organization and month: tokens and exact cost."""
    r = reports.select(F.col("id").alias("report_id"), "organization_id")
    done = attempts.where(F.col("ai_model").isNotNull()).join(r, "report_id").withColumn("month", F.date_format("finished_at", "yyyy-MM"))
    return done.rollup("organization_id", "month").agg(
        F.sum("ai_input_tokens").alias("input_tokens"), F.sum("ai_output_tokens").alias("output_tokens"), F.sum("ai_cost_usd").alias("cost"), F.count("*").alias("n"),
    )


def model_costs(attempts: DataFrame) -> DataFrame:
    """M3: by model and month: tokens, exact cost and attempts."""
    done = attempts.where(F.col("ai_model").isNotNull()).withColumn("month", F.date_format("finished_at", "yyyy-MM"))
    return done.groupBy("ai_model", "month").agg(
        F.sum("ai_input_tokens").alias("input_tokens"), F.sum("ai_output_tokens").alias("output_tokens"), F.sum("ai_cost_usd").alias("cost"), F.count("*").alias("n"),
    )


def rejection_rates(rejections: DataFrame, reports: DataFrame) -> DataFrame:
    """M6: by organization: uploads, those rejected, and their share; an upload is a report or a rejection."""
    both = rejections.select("organization_id", F.lit(1).alias("rejected")).unionByName(reports.select("organization_id", F.lit(0).alias("rejected")))
    n = both.groupBy("organization_id").agg(F.count("*").alias("uploads"), F.sum("rejected").alias("rejected"))
    return n.withColumn("rate", F.col("rejected") / F.col("uploads"))


def failure_rates(attempts: DataFrame, alert: float) -> DataFrame:
    """M4: per month: finished, failed, rate, alert; and the failures by reason as a map."""
    done = attempts.where(F.col("finished_at").isNotNull()).withColumn("month", F.date_format("finished_at", "yyyy-MM"))
    n = done.groupBy("month").agg(F.count("*").alias("finished"), F.count_if(F.col("status") == "failed").alias("failed"))
    return n.withColumn("rate", F.col("failed") / F.col("finished")).withColumn("alert", F.col("rate") > alert)


def failures_by_reason(attempts: DataFrame) -> DataFrame:
    return attempts.where("status = 'failed'").groupBy("failure_reason").agg(F.count("*").alias("n"))


def rejection_cube(rejections: DataFrame) -> DataFrame:
    """M6: counts by organization and reason with all totals."""
    return rejections.cube("organization_id", "rejection_reason").agg(F.count("*").alias("n"))


def to_kg(weight: Column, unit: Column) -> Column:
    """M12."""
    return F.when(unit == "lb", weight * LB_IN_KG).otherwise(weight)


def weight_by_month(rows: DataFrame) -> DataFrame:
    """M7: upload, month, weight of accepted rows of upload, iso, weight."""
    return rows.groupBy("upload", F.substring("iso", 1, 7).alias("month")).agg(F.sum("weight").alias("weight"))


def per_person(by_month: DataFrame, counts: DataFrame) -> DataFrame:
    """M7: weight over the month's count; rows of upload, counts (map)."""
    each = counts.select("upload", F.explode("counts").alias("month", "count"))
    return by_month.join(each.hint("merge"), ["upload", "month"]).withColumn("per_person", F.when(F.col("count") > 0, F.col("weight") / F.col("count")))


def top_products(rows: DataFrame, n: int) -> DataFrame:
    """M8: the n heaviest products of each upload; ties by name."""
    sums = rows.groupBy("upload", "product").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("upload").orderBy(F.desc("weight"), "product")
    return sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def by_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Month, category, weight with a supplied table of product, category; unknown products are 'uncategorized'."""
    sums = rows.groupBy("product", F.substring("iso", 1, 7).alias("month")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    met = sums.join(categories.select("product", "category").hint("merge"), "product", "left")
    return met.groupBy("month", F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def to_review(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Products that no approved entry covers, with how often they were seen."""
    approved = categories.where("approved").select("product")
    return rows.groupBy("product").agg(F.count("*").alias("n")).join(approved.hint("merge"), "product", "left_anti")


def run_counters(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Per upload: rows in, rows categorized, distinct products uncategorized."""
    met = rows.join(categories.select("product", "category"), "product", "left")
    return met.groupBy("upload").agg(
        F.count("*").alias("rows_in"), F.count("category").alias("rows_categorized"), F.count_distinct(F.when(F.col("category").isNull(), F.col("product"))).alias("products_uncategorized"),
    )
