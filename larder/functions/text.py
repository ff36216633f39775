"""Scalar functions on strings, identifiers and moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import fixed

SPACE = r"[\s\p{Z}\x{FEFF}\x0B]"
"""What the trimming rule removes: all Unicode space and the byte order mark, but not U+0085."""
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
MONTH_KEY = r"^\d{4}-(0[1-9]|1[0-2])\z"
SNAKE_KEY = r"^[a-z0-9]+(_[a-z0-9]+)*\z"


def trim(c: Column) -> Column:
    """Strip Unicode space at both ends; most texts begin and end in visible ASCII, which shows at a glance."""
    visible = (c >= "!") & (c < "\x7f") & F.substring(c, -1, 1).between("!", "~")
    return F.when(visible, c).otherwise(F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", ""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; characters beyond the basic plane count twice."""
    n = F.char_length(c)
    return F.when(F.octet_length(c) == n, n).otherwise(n + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]")))


def number_text(c: Column) -> Column:
    """A double as JavaScript writes it: no trailing '.0', exponents from 1e21 and below 1e-6."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", c), r"0+\z", ""), r"\.\z", "")
    text = c.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0\z", "")
    exponent = F.regexp_extract(text, r"E(-?\d+)\z", 1)
    sign = F.when(exponent.startswith("-"), "").otherwise("+")
    big = c.cast("decimal(38,0)").cast("string")
    return (
        F.when(c.isNull(), None)
        .when(c == 0, "0")
        .when((F.abs(c) >= 1e21) | (F.abs(c) < 1e-6), F.concat(mantissa, F.lit("e"), sign, exponent))
        .when(text.contains("E") & (F.abs(c) >= 1), F.when(c == F.floor(c), big).otherwise(plain))
        .when(text.contains("E"), F.regexp_replace(c.cast("decimal(38,20)").cast("string"), r"0+\z", ""))
        .otherwise(F.regexp_replace(text, r"\.0\z", ""))
    )


def uuid_time(c: Column) -> Column:
    """T4: the creation time in a version 7 identifier; null for other versions."""
    digits = F.concat(F.substring(c, 1, 8), F.substring(c, 10, 4))
    return F.when(uuid_version(c) == 7, F.timestamp_millis(F.conv(digits, 16, 10).cast("long")))


def uuid_version(c: Column) -> Column:
    return F.when(c.rlike(UUID), F.conv(F.substring(c, 15, 1), 16, 10).cast("int"))


def group_digits(c: Column) -> Column:
    """T5: thousands separated by commas."""
    return F.format_number(c.cast("long"), 0)


def list_of(items: Column) -> Column:
    """T6: 'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    return F.when(n <= 1, F.coalesce(F.get(items, F.lit(0)), F.lit(""))).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1))
    )


def oxford_list(items: Column) -> Column:
    """'a', 'a and b', 'a, b, and c'."""
    n = F.size(items)
    return F.when(n <= 2, F.array_join(items, " and ")).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1))
    )


def plural(n: Column, noun: str) -> Column:
    return F.when(n == 1, noun).otherwise(noun + "s")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def storage_key(org: Column, *segments: Column) -> Column:
    """A key beneath an organization's prefix."""
    return F.concat_ws("/", F.lit("org"), org, *segments)


def content_disposition(name: Column) -> Column:
    """An attachment header with an ASCII fallback and the percent-encoded UTF-8 name."""
    ascii_name = F.regexp_replace(F.regexp_replace(name, r"[^\x20-\x7e]", "_"), r'["\\]', "")
    encoded = F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    encoded = F.replace(encoded, F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit('attachment; filename="'), ascii_name, F.lit("\"; filename*=UTF-8''"), encoded)


def report_url(site: str, org: Column, report: Column) -> Column:
    """Link columns."""
    return F.concat(F.lit(f"{site}/orgs/"), org, F.lit("/reports/"), report)


def result_file_url(site: str, file: Column) -> Column:
    return F.concat(F.lit(f"{site}/file/result/"), file)


def sign_in_url(site: str, email: Column) -> Column:
    return F.concat(F.lit(f"{site}/sign-in?email="), F.replace(F.url_encode(email), F.lit("+"), F.lit("%20")))


def utf16_prefix(c: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units of a text, one fewer where that would keep half a pair."""
    units = F.encode(c, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * n - 1, 1))
    half = last.between("D8", "DB")
    return F.when(F.octet_length(units) <= 2 * n, c).otherwise(F.decode(F.substring(units, F.lit(1), F.when(half, 2 * n - 2).otherwise(2 * n)), "UTF-16BE"))


def file_extension(kind: Column) -> Column:
    """What a result file's key ends in; null for another kind."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, (e, _) in fixed.RESULT_KINDS.items() for x in (k, e)]), kind)


def content_type(kind: Column) -> Column:
    """How a result file is served; null for another kind."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, (_, t) in fixed.RESULT_KINDS.items() for x in (k, t)]), kind)


def is_month_key(c: Column) -> Column:
    """T12."""
    return c.rlike(MONTH_KEY)


def ago(now: Column, seconds: float) -> Column:
    """So many seconds before ``now``."""
    return now - F.make_dt_interval(secs=F.lit(seconds))


def chart_file(key: Column) -> Column:
    """The file of a chart; null for a key that is not snake case."""
    return F.when(key.rlike(SNAKE_KEY), F.concat(F.lit("chart-"), key, F.lit(".png")))


def is_uuid(c: Column) -> Column:
    """T15."""
    return F.coalesce(c.rlike(UUID), F.lit(False))


def blank_to_null(c: Column) -> Column:
    """An absent or blank form field is null."""
    return F.nullif(trim(c), F.lit(""))
