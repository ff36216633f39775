"""Cell rules: products, weights, dates, and the date order of a whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.functions.text import trim, utf16_length

INVISIBLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}]"
PLAIN_NUMBER = r"^(\d+|\d{1,3}(,\d{3})+)(\.\d+)?\z"
SCIENTIFIC = r"(?i)^\d+(\.\d+)?e[+-]?\d+\z"
YEAR_FIRST = r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})\z"
YEAR_FIRST_TIME = (
    r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})[t ]\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:z|[+-]\d{2}:?\d{2})?\z"
)
COMPACT = r"^(\d{4})(\d{2})(\d{2})\z"
YEAR_MONTH = r"^(\d{4})[/.-](\d{1,2})\z"
MONTH_YEAR = r"^(\d{1,2})[/.-](\d{4})\z"
DAY_NAME_YEAR = r"^(\d{1,2})[ -]+([a-z]+)[ -]+(\d{2,4})\z"
NAME_DAY_YEAR = r"^([a-z]+)[ -]+(\d{1,2})[ -]+(\d{2,4})\z"
NAME_YEAR = r"^([a-z]+)[ -]+(\d{4})\z"
YEAR_LAST = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})\z"
SERIAL = r"^\d+(\.\d+)?\z"
ANY_DATE = ("0000-01-01", "9999-12-31")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are computed once for each row.

    As a generator's output they are not substituted into the filters and
    projections above, where each mention would repeat the whole rule. Under a
    lambda they stay out of the stage's generated method, which a few rules make
    very long.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.transform(F.array(F.lit(0)), lambda _: made)))


def compiled(df: DataFrame, **columns: Column) -> DataFrame:
    """As ``once``, for rules of many steps: they run as compiled code, and the generator only hands on what they gave.

    The lambda beside them keeps their projection out of the stage's one long
    generated method, so it is cut into short ones.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    each = F.transform(F.array(F.col(df.columns[0])), lambda _: F.lit(0))
    held = df.select("*", made.alias("_made"), each.alias("_each"))
    return held.select(*df.columns, F.inline(F.transform("_each", lambda _: F.col("_made"))))


def projected(df: DataFrame, through: str, **columns: Column) -> DataFrame:
    """As ``compiled``, where no filter on the columns follows at once: a projection, which copies a row once.

    It keeps the order and the partitioning of the rows, as no generator does.
    The lambda that keeps it out of the stage's generated method hands on the
    cheap column ``through``. Spark leaves projections apart where a later one
    reads a costly column more than once.
    """
    held = columns.get(through, F.col(through))
    made = columns | {through: F.get(F.transform(F.array(held), lambda x: x), F.lit(0))}
    return df.withColumns(made)


def bounds_at(now: str) -> tuple[str, str]:
    """The accepted range for one moment ('YYYY-MM-DD ...', UTC)."""
    from datetime import date, timedelta

    return fixed.EARLIEST_DATE, (date.fromisoformat(now[:10]) + timedelta(days=fixed.MAX_FUTURE_DAYS)).isoformat()


def of(value: Column, rule) -> Column:
    """``rule`` of a value that is computed once, however often the rule mentions it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def read_product(raw: Column) -> Column:
    """V4, V5: struct of value and fault; the fault 'formula' is a kind of its own."""
    return of(trim(raw), _product)


def _product(text: Column) -> Column:
    return F.struct(text.alias("value"), product_fault(text).alias("fault"))


def product_fault(text: Column) -> Column:
    """V4, V5 of a trimmed text."""
    return (
        F.when(text == "", "empty")
        .when((F.length(text) <= max(map(len, fixed.PLACEHOLDERS))) & F.lower(text).isin(fixed.PLACEHOLDERS), "placeholder")
        .when(~text.rlike(r"^[ -~]*\z") & text.rlike(INVISIBLE), "invisible-character")
        .when(F.substring(text, 1, 1).isin("=", "+", "-", "@"), "formula")
    )

def read_weight(raw: Column) -> Column:
    """V6: struct of value and fault."""
    return of(trim(raw), _weight)


def _weight(text: Column) -> Column:
    fault = weight_fault(text)
    return F.struct(F.when(fault.isNull(), weight_value(text)).alias("value"), fault.alias("fault"))


def weight_value(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def weight_fault(text: Column) -> Column:
    """V6 of a trimmed text. A plain number has none of the other faults, so it is tried first."""
    long_ = (F.length(text) > fixed.MAX_WEIGHT_DIGITS) & (F.length(F.regexp_replace(text, "[,.]", "")) > fixed.MAX_WEIGHT_DIGITS)
    return (
        F.when(text == "", "empty")
        .when(text.rlike(PLAIN_NUMBER), F.when(long_, "too-many-digits"))
        .when(text.rlike(r"^\([^\n\r]*\)\z"), "parenthesized-negative")
        .when(text.startswith("-"), "negative")
        .when(text.rlike(f"[{fixed.CURRENCY_SYMBOLS}]"), "money")
        .when(text.rlike(SCIENTIFIC), "scientific")
        .when(text.rlike("[A-Za-z]"), F.when(text.rlike("[0-9]"), "has-a-unit").otherwise("not-a-number"))
        .when(text.isNotNull(), F.when(text.contains(","), "comma-decimal").otherwise("not-plain"))
    )


def calendar(year: Column, month: Column, day: Column, bounds: tuple[str, str]) -> Column:
    """V9: struct of iso and fault. Years before 100 are no real dates, and none is after 9999; nulls give nulls."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    real = month.between(1, 12) & (day >= 1) & (day <= days) & (year >= 100)
    at = year * 10000 + month * 100 + day
    low, high = (int(b.replace("-", "")) for b in bounds)
    fault = F.when(~real, "not-a-real-date").when(at < low, "too-old").when(at > high, "too-far-ahead")
    iso = F.when(real & (at >= low) & (at <= high), F.make_date(year, month, day).cast("string"))
    return F.struct(iso.alias("iso"), fault.alias("fault"))


def clean_date(raw: Column) -> Column:
    """Spaces folded, then commas deleted, lower case."""
    folded = F.when(raw.rlike(r"^[!-~]+\z"), raw).otherwise(F.regexp_replace(trim(raw), r"[\s\p{Z}\x{FEFF}\x0B]+", " "))
    return F.lower(F.replace(folded, F.lit(","), F.lit("")))


def date_parts(text: Column) -> Column:
    """V7, V8: struct of kind ('date', 'numeric' or a fault), year, month, day - or first, second for numeric.

    ``text`` is cleaned. The grammars are tried in order; those that begin with a
    year, those with a word and the rest shut each other out.
    """

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group).try_cast("int")

    def digits(start: Column | int) -> Column:
        """The one or two digits at a place; what may stand by them is a separator."""
        return F.translate(F.substring(text, start, F.lit(2) if isinstance(start, Column) else 2), "/.- t", "")

    def at(start: Column | int) -> Column:
        return digits(start).try_cast("int")

    def year(pattern: str, group: int) -> Column:
        """The last number of a grammar with words; two digits have a separator before them."""
        n = number(pattern, group)
        return F.when(F.substring(text, -3, 1).isin(" ", "-"), n + 2000).otherwise(n)

    names = F.create_map(*[F.lit(x) for pair in fixed.MONTHS.items() for x in pair])

    def parts(kind: Column | str, y: Column, m: Column, d: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), y.alias("year"), m.alias("month"), d.alias("day"))

    def named(pattern: str, y: int, name: int, d: int | None) -> Column:
        m = F.try_element_at(names, F.regexp_extract(text, pattern, name))
        day = F.lit(1) if d is None else number(pattern, d)
        return parts(F.when(m.isNull(), "unknown-month-name").otherwise("date"), year(pattern, y), m, day)

    none = F.lit(None).cast("int")
    first_year, last_year = F.substring(text, 1, 4).try_cast("int"), F.substring(text, -4, 4).try_cast("int")
    serial = F.when(text.rlike(SERIAL), parts("date-serial", none, none, none)).otherwise(parts("unrecognized", none, none, none))
    leading = F.when(text.rlike(YEAR_FIRST), parts("date", first_year, at(6), at(-2)))
    day_at = F.when(F.substring(text, 7, 1).between("0", "9"), 9).otherwise(8)
    leading = leading.when(text.rlike(YEAR_FIRST_TIME), parts("date", first_year, at(6), at(day_at)))
    leading = leading.when(text.rlike(COMPACT), parts("date", *[F.substring(text, i, n).try_cast("int") for i, n in ((1, 4), (5, 2), (7, 2))]))
    leading = leading.when(text.rlike(YEAR_MONTH), parts("date", first_year, at(6), F.lit(1)))
    worded = (
        F.when(text.rlike(DAY_NAME_YEAR), named(DAY_NAME_YEAR, 3, 2, 1))
        .when(text.rlike(NAME_DAY_YEAR), named(NAME_DAY_YEAR, 3, 1, 2))
        .when(text.rlike(NAME_YEAR), named(NAME_YEAR, 2, 1, None))
        .otherwise(parts("unrecognized", none, none, none))
    )
    first, second = at(1), at(F.length(digits(1)) + 2)
    both = (first > 12) & (second > 12)
    numeric = parts(F.when(both, "not-a-real-date").otherwise("numeric"), F.when(text.rlike(r"\d{4}\z"), last_year).otherwise(F.substring(text, -2, 2).try_cast("int") + 2000), first, second)
    trailing = (
        F.when(text.rlike(MONTH_YEAR), parts("date", last_year, at(1), F.lit(1)))
        .when(text.rlike(YEAR_LAST), numeric)
        .otherwise(serial)
    )
    return (
        F.when(text == "", parts("empty", none, none, none))
        .when(text.rlike(r"^\d{4}"), leading.otherwise(serial))
        .when(text.rlike("[a-z]"), worded)
        .otherwise(trailing)
    )


def order_proven(first: Column, second: Column) -> Column:
    """Which order a numeric date proves, if any."""
    return F.when(first > 12, "day-first").when(second > 12, "month-first")


def read_cells(rows: DataFrame, now: str, filtered: bool = True) -> DataFrame:
    """V1-V12 on rows of upload, line, product, date, weight (raw), and optionally actual, expected (widths).

    Adds product_value, product_fault, weight_value, weight_fault, date_kind
    ('date', 'numeric', 'invalid'), date_fault, iso, first, second, year,
    by_day, by_month (iso and fault of a numeric date under either order),
    too_long (array of columns), wrong_width, ok. A row of the wrong width, and
    then one with an over-long cell, is read no further. ``filtered``: the caller
    may filter by what is added; else the steps are plain projections, which keep
    rows that come sorted by upload as they are.
    """

    def step(df: DataFrame, **columns: Column) -> DataFrame:
        return compiled(df, **columns) if filtered else projected(df, "ok" if "ok" in columns else "readable", **columns)

    if "actual" not in rows.columns:
        rows = rows.withColumns({"actual": F.lit(3), "expected": F.lit(3)})
    for c in fixed.REQUIRED_COLUMNS:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    over = [F.when(utf16_length(F.col(c)) > fixed.MAX_FREE_TEXT_LENGTH, c) for c in fixed.REQUIRED_COLUMNS]
    none = F.array().cast("array<string>")
    short = F.lit(True)
    for c in fixed.REQUIRED_COLUMNS:  # no text has more units than bytes
        short &= F.octet_length(F.col(c)) <= fixed.MAX_FREE_TEXT_LENGTH
    rows = rows.withColumn("wrong_width", F.col("actual") != F.col("expected")).withColumn(
        "too_long", F.when(F.col("wrong_width") | short, none).otherwise(F.array_compact(F.array(*over)))
    )
    readable = ~F.col("wrong_width") & (F.size("too_long") == 0)
    rows = step(
        rows,
        readable=readable,
        p=F.when(readable, trim(F.col("product"))),
        w=F.when(readable, trim(F.col("weight"))),
        cleaned=F.when(readable, clean_date(F.col("date"))),
    )
    rows = step(rows, pf=product_fault(F.col("p")), wf=weight_fault(F.col("w")), d=F.when(F.col("readable"), date_parts(F.col("cleaned"))))
    numeric = F.col("d.kind") == "numeric"
    year, month, day = F.col("d.year"), F.col("d.month"), F.col("d.day")
    rows = step(
        rows,
        c=F.when(F.col("d.kind") == "date", calendar(year, month, day, bounds_at(now))),
        by_day=F.when(numeric, calendar(year, day, month, bounds_at(now))),
        by_month=F.when(numeric, calendar(year, month, day, bounds_at(now))),
    )
    fault = F.when(F.col("d.kind") == "date", F.col("c.fault")).when(~numeric, F.col("d.kind"))
    fine = F.col("readable") & F.col("pf").isNull() & F.col("wf").isNull() & fault.isNull()
    passed = ("p", "w", "pf", "wf", "d", "c", "cleaned")
    kept = [c for c in rows.columns if c not in passed]
    return step(
        rows,
        product_value=F.when(F.col("pf").isNull(), F.col("p")),
        product_fault=F.col("pf"),
        weight_value=F.when(F.col("wf").isNull(), weight_value(F.col("w"))),
        weight_fault=F.col("wf"),
        date_fault=fault,
        date_kind=F.when(fault.isNotNull(), "invalid").when(numeric, "numeric").when(F.col("readable"), "date"),
        iso=F.col("c.iso"),
        first=F.when(numeric, F.col("d.month")),
        second=F.when(numeric, F.col("d.day")),
        year=F.when(numeric, F.col("d.year")),
        ok=F.coalesce(fine, F.lit(False)),
    ).select(
        *kept, "product_value", "product_fault", "weight_value", "weight_fault", "date_fault", "date_kind", "iso", "first", "second", "year", "ok"
    )


def _vote() -> Column:
    vote = F.coalesce(order_proven(F.col("first"), F.col("second")), F.lit("ambiguous"))
    return F.when(F.col("ok") & (F.col("date_kind") == "numeric"), vote)


def _order(day: Column, month: Column, open_: Column) -> tuple[Column, Column]:
    """date_order and order_fault by which classes of dates an upload has."""
    fault = F.when(day & month, "contradictory").when(~day & ~month & open_, "unresolvable")
    order = F.when(day & ~month, "day-first").when(month & ~day, "month-first").when(~day & ~month & ~open_, "month-first")
    return order, fault


def decide_order(read: DataFrame) -> DataFrame:
    """One row per upload: date_order or order_fault, and the first example of each class.

    Only rows that passed every cell rule vote.
    """
    votes = read.select("upload", "line", "date", "first", "second", "year", _vote().alias("class"))
    example = F.struct("line", "date", "first", "second", "year")

    def first_of(name: str) -> Column:
        return F.min(F.when(F.col("class") == name, example))

    met = votes.groupBy("upload").agg(
        F.count("*").alias("rows_read"),
        first_of("day-first").alias("day_first"), first_of("month-first").alias("month_first"), first_of("ambiguous").alias("ambiguous"),
    )
    order, fault = _order(*(F.col(c).isNotNull() for c in ("day_first", "month_first", "ambiguous")))
    return met.select("upload", "rows_read", order.alias("date_order"), fault.alias("order_fault"), "day_first", "month_first", "ambiguous")


def judge(read: DataFrame, now: str) -> DataFrame:
    """Every row with date_order, order_fault, resolved_iso, resolved_fault and refused (is its upload?).

    An upload's rows are together by then, so its order and its refusal are
    window values: nothing of one row an upload is made, joined or broadcast.
    """
    whole = Window.partitionBy("upload")
    bad = F.coalesce("wrong_width", F.lit(False)) | (F.size("too_long") > 0)
    for fault in ("product_fault", "weight_fault", "date_fault"):
        bad |= F.col(fault).isNotNull()
    seen = {c: F.col("class") == c for c in ("day-first", "month-first", "ambiguous")}
    seen |= {c: F.col("ok") & F.col(f"{c}.fault").isNotNull() for c in ("by_day", "by_month")} | {"bad": bad}
    rows = read.withColumn("class", _vote())
    rows = rows.withColumns({f"any_{c}": F.coalesce(F.max(s).over(whole), F.lit(False)) for c, s in seen.items()})
    some = {c: F.col(f"any_{c}") for c in seen}
    order, order_fault = _order(some["day-first"], some["month-first"], some["ambiguous"])
    rows = rows.withColumns({"date_order": order, "order_fault": order_fault})
    day_first = F.col("date_order") == "day-first"
    later = F.when(day_first, some["by_day"]).otherwise(some["by_month"])
    open_ = F.col("ok") & F.col("order_fault").isNull()
    met = F.when(day_first, F.col("by_day")).otherwise(F.col("by_month"))
    rows = rows.withColumns(
        {
            "resolved_iso": F.when(open_, F.when(F.col("date_kind") == "date", F.col("iso")).otherwise(met["iso"])),
            "resolved_fault": F.when(open_ & (F.col("date_kind") == "numeric"), met["fault"]),
            "refused": some["bad"] | F.col("order_fault").isNotNull() | later,
        }
    )
    return rows.drop("class", "by_day", "by_month", *[f"any_{c}" for c in seen])


def late_faults(read: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows that passed and have a resolved_fault; only those that are at fault under some order meet their upload's."""
    passed = F.col("ok") & F.col("upload").isNotNull()
    some = read.where(passed & (F.col("by_day.fault").isNotNull() | F.col("by_month.fault").isNotNull()))
    met = some.join(decided.select("upload", "date_order", "order_fault").hint("merge"), "upload")
    fault = F.when(F.col("date_order") == "day-first", F.col("by_day.fault")).otherwise(F.col("by_month.fault"))
    return met.withColumn("resolved_fault", F.when(F.col("order_fault").isNull(), fault)).where(F.col("resolved_fault").isNotNull())


def resolved_rows(judged: DataFrame) -> DataFrame:
    """The rows that passed every cell rule, of named uploads."""
    return judged.where(F.col("ok") & F.col("upload").isNotNull())


def both_readings(first: Column, second: Column, year: Column) -> Column:
    """Struct of day_first and month_first ISO dates, whatever the range."""
    return F.struct(
        calendar(year, second, first, ANY_DATE)["iso"].alias("day_first"),
        calendar(year, first, second, ANY_DATE)["iso"].alias("month_first"),
    )
