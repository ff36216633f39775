"""What surrounds the rows of an upload: output text, month coverage, form fields, the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.functions.text import MONTH_KEY, blank_to_null, number_text, oxford_list, trim, utf16_length, utf16_prefix
from larder.operators.rules import projected

SIMPLE_COUNTS = r'^\{"M": ?N(?:, ?"M": ?N)*+\}\z'.replace("M", r"\d{4}-(?:0[1-9]|1[0-2])").replace("N", r"(?:0|[1-9]\d{0,14})")
"""Counts as most forms have them: months and whole numbers, which need no parser."""


def escape_field(c: Column) -> Column:
    """Quoted only where a quote, comma or line break asks for it."""
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def output_line(product: Column, iso: Column, weight: Column) -> Column:
    """One line of the normalized file."""
    return F.concat_ws(",", escape_field(product), iso, number_text(weight))


def _missing() -> Column:
    return F.array_except("months", F.map_keys("counts"))


def _coverage_words(missing: Column) -> tuple[Column, Column]:
    """Summary and detail for months without a count, of which there is one at least."""
    those = F.when(F.size(missing) == 1, "that month").otherwise("those months")
    summary = F.concat(F.lit("Your file has orders in "), oxford_list(missing), F.lit(", but you did not give a count for "), those, F.lit("."))
    return summary, F.concat(F.lit("months in the file with no count: "), F.array_join(missing, ", "))


def coverage(counted: DataFrame) -> DataFrame:
    """Rows of upload, months (array), counts (map): the months without a count as summary and detail, else nulls."""
    missing = _missing()
    summary, detail = _coverage_words(missing)
    some = F.size(missing) > 0
    return counted.withColumns({"summary": F.when(some, summary), "detail": F.when(some, detail)})


def uncovered(counted: DataFrame) -> DataFrame:
    """The rows of ``coverage`` with a month without a count; a filter compares months once, and words are made of what it leaves."""
    found = counted.withColumn("_missing", _missing()).where(F.size("_missing") > 0)
    summary, detail = _coverage_words(F.col("_missing"))
    return found.withColumns({"summary": summary, "detail": detail}).drop("_missing")


def describe_input(original: Column, normalized: Column) -> list[Column]:
    """What is stored of an input file, from its bytes alone; is_modified where they are not the ones sent."""
    return [
        F.length(normalized).alias("byte_size"), F.sha2(normalized, 256).alias("checksum"), (original != normalized).alias("is_modified"),
    ]


def check_metadata(forms: DataFrame) -> DataFrame:
    """Rows of name, site_name, counts_basis, unit_system, counts (JSON text): adds bad_fields (array), site (blank is null) and counted (the keys of counts).

    Every bad field is reported, not just the first. Counts: 1 to 120 keys
    YYYY-MM with whole numbers of 0 or more; a whole decimal such as 3.0 passes.
    Texts as SIMPLE_COUNTS without a month twice are good if they are not too many; all others are parsed.
    """
    given = forms.columns
    forms = projected(forms, "counts", simple=F.when(F.col("counts").rlike(SIMPLE_COUNTS), F.regexp_extract_all("counts", F.lit('"([0-9-]{7})"'), F.lit(1))))
    forms = projected(forms, "counts", simple=F.when(F.size(F.array_distinct("simple")) == F.size("simple"), F.col("simple")))
    name = trim(F.coalesce("name", F.lit("")))
    site = blank_to_null(F.col("site_name"))
    counts = F.from_json("counts", "map<string,string>")
    raw = F.try_parse_json("counts")
    keys, values = F.map_keys(counts), F.map_values(counts)
    whole = F.forall(values, lambda v: F.coalesce(v.rlike(r"^\d+(\.0+)?\z"), F.lit(False)))
    typed = F.coalesce(F.schema_of_variant(raw).rlike(r"^OBJECT<"), F.lit(False)) & ~F.coalesce(F.schema_of_variant(raw).rlike("STRING|BOOLEAN|ARRAY|VOID"), F.lit(True))
    parsed = typed & (F.size(keys) >= 1) & (F.size(keys) <= fixed.MAX_MONTHS) & F.forall(keys, lambda k: k.rlike(MONTH_KEY)) & whole
    plain = F.col("simple").isNotNull()
    good = F.when(plain, F.size("simple") <= fixed.MAX_MONTHS).otherwise(parsed)
    bad = F.array_compact(
        F.array(
            F.when((name == "") | (utf16_length(name) > fixed.MAX_FREE_TEXT_LENGTH), "name"),
            F.when(utf16_length(F.coalesce(site, F.lit(""))) > fixed.MAX_FREE_TEXT_LENGTH, "siteName"),
            F.when(~F.coalesce(F.col("counts_basis").isin(fixed.COUNTS_BASES), F.lit(False)), "countsBasis"),
            F.when(~F.coalesce(F.col("unit_system").isin(fixed.UNIT_SYSTEMS), F.lit(False)), "unitSystem"),
            F.when(~F.coalesce(good, F.lit(False)), "monthlyCounts"),
        )
    )
    forms = projected(forms, "counts", bad_fields=bad, site=site, counted=F.when(plain, F.col("simple")).otherwise(keys))
    return forms.select(*given, *[c for c in ("bad_fields", "site", "counted") if c not in given])


def verdict(read: DataFrame, forms: DataFrame) -> DataFrame:
    """Upload, verdict, uncounted - the first reason to refuse an upload, or accepted.

    ``read``: upload, gate, reason (why no row was read from its file), refused (are
    rows of it bad?), months of accepted rows, or null; ``forms``: one row per upload with
    the fields of ``check_metadata``, counts as JSON text. A file that is too large
    or has no bytes is refused before its form is read, its form before its
    content, months without a count last (``uncounted`` names them). An upload
    without a form lacks every field.
    """
    checked = check_metadata(forms).select("upload", (F.size("bad_fields") > 0).alias("bad_form"), "counted")
    met = read.join(checked.hint("merge"), "upload", "left")
    first = F.coalesce(
        F.when(F.col("gate").isin("too-large", "empty"), F.col("reason")), F.when(F.coalesce("bad_form", F.lit(True)), "invalid_metadata"),
        "reason", F.when(F.col("refused"), "bad_rows"),
    )
    missing = F.array_except(F.col("months"), F.col("counted"))
    met = met.select("upload", first.alias("first"), F.when(first.isNull(), missing).alias("missing"))
    some = F.coalesce(F.size("missing") > 0, F.lit(False))
    return met.select(
        "upload",
        F.coalesce("first", F.when(some, "invalid_metadata"), F.lit("accepted")).alias("verdict"),
        F.when(some, _coverage_words(F.array_sort("missing"))[1]).alias("uncounted"),
    )


def stored_filename(c: Column) -> Column:
    """The first UTF-16 units of a long name."""
    return utf16_prefix(c, fixed.MAX_ORIGINAL_FILENAME_LENGTH)
