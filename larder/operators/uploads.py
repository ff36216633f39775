"""Uploaded files: decoding, tokenizing, finding the layout - one row per file until its records are exploded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import fixed
from larder.functions.text import group_digits, list_of, trim
from larder.operators.rules import compiled, of, once, projected

# File signatures, and what Windows-1252 has at 0x80-0x9F (the five unused bytes stay as they are).
SIGNATURES = {"xlsx": "504B", "xls": "D0CF11E0A1B11AE1"}
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def decode(files: DataFrame) -> DataFrame:
    """Adds text (line ends as \\n) and gate, the first fault of too-large, empty, signature-*, control-character, blank.

    ``files``: upload, content, size. Also control_code and control_offset.
    """
    content = F.col("content")
    gate = F.when(F.col("size") > fixed.MAX_UPLOAD_BYTES, "too-large").when(F.col("size") == 0, "empty")
    for kind, head in SIGNATURES.items():
        n = len(head) // 2
        gate = gate.when(F.hex(F.substring(content, 1, n)) == head, f"signature-{kind}")
    mark = F.hex(F.substring(content, 1, 2))
    ansi = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)
    text = (
        F.when(mark == "FFFE", F.decode(content, "UTF-16LE"))
        .when(mark == "FEFF", F.decode(content, "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(ansi)
    )
    text = of(text, lambda t: F.when(t.startswith("\ufeff"), F.substring(t, F.lit(2), F.length(t))).otherwise(t))
    text = of(text, lambda t: F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))
    files = files.withColumn("gate0", gate)
    files = projected(files, "gate0", text=F.when(F.col("gate0").isNull(), text))
    at = F.regexp_instr("text", F.lit(CONTROL))
    files = projected(files, "gate0", at=at, blank=trim(F.col("text")) == "")
    later = F.when(F.col("at") > 0, "control-character").when(F.col("blank"), "blank")
    return compiled(
        files,
        gate=F.coalesce("gate0", later),
        control_code=F.when(F.col("at") > 0, F.ascii(F.substring(F.col("text"), F.col("at"), F.lit(1)))),
        control_offset=F.when(F.col("at") > 0, F.col("at") - 1),
    ).drop("gate0", "at", "blank")


def _by_delimiter(delimiter: Column, pattern: str, apply) -> Column:
    """``apply(pattern)`` with the delimiter in it; four literals, so the compiled patterns are kept."""
    out = F.lit(None)
    for d in fixed.DELIMITERS:
        name = {"\t": r"\t", "|": r"\|"}.get(d, d)
        out = F.when(delimiter == d, apply(pattern.replace("«F»", _FIELD).replace("«d»", name).replace("«D»", name))).otherwise(out)
    return out


_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"(?=[«D»\n]|\z)|(?!")[^«D»\n]*+)'
RECORD = r"\G(?!\z)(?:«F»«d»){0,24}+«F»(?:\n|\z)"
FIELD = r"\G«F»(?:[«D»\n]|\z)"
# The first records with the empty lines before each, and the empty lines after the last.
HEAD = r"^(?:\n*+(?!\z)(?:«F»«d»){0,24}+«F»(?:\n|\z)){0,«N»}+\n*+"
HEAD_RECORD = r"\G\n*+(?!\z)(?:«F»«d»){0,24}+«F»(?:\n|\z)"
LEAD = r"^(?:«F»«d»){0,25}+"
WIDE = r"^(?:«F»«d»){25}«F»"
CLOSED = r'^"[^"]*+(?:""[^"]*+)*+"'
WIDE_LINE = r"(?m)^(?:[^«D»\n]*+«d»){25}"  # of a text without quotes
QUOTE = '"'
BLOCK = 128
"""Records whose lines are summed together."""


def _count(text: Column, c: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, c, F.lit("")))


def _lines(c: Column) -> Column:
    return _count(c, F.lit("\n"))


def _sum(numbers: Column, start: int = 0) -> Column:
    return F.aggregate(numbers, F.lit(start), lambda total, n: total + n)


def _after(text: Column, consumed: Column) -> Column:
    return F.substring(text, consumed + 1, F.length(text))


def _split(record: Column, delimiter: Column) -> Column:
    """The raw fields of one record, each with what ends it."""
    return _by_delimiter(delimiter, FIELD, lambda p: F.regexp_extract_all(record, F.lit(p), F.lit(0)))


def _bare_fields(record: Column, delimiter: Column) -> Column:
    """The values of a record without quotes and line end: what ``_split`` and ``_unquote`` give, without their patterns."""
    return _by_delimiter(delimiter, "«d»", lambda p: F.split(record, p))


def _unquote(tokens: Column, delimiter: Column) -> Column:
    """The values of raw fields; the empty match after the last field is none."""
    n = F.size(tokens)
    last_empty = (F.element_at(tokens, -1) == "") & (n > 1) & ~F.element_at(tokens, -2).endswith(delimiter)

    def unwrap(t: Column) -> Column:
        bare = F.when(t.endswith("\n") | t.endswith(delimiter), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
        inner = F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))
        return F.when(bare.startswith('"'), inner).otherwise(bare)

    return F.transform(F.slice(tokens, F.lit(1), F.when(last_empty, n - 1).otherwise(n)), unwrap)


def _fault(rest: Column, delimiter: Column, start: Column) -> Column:
    """Struct of fault and line of a text that begins, on line ``start``, with a record that cannot be read; null of null."""
    wide = _by_delimiter(delimiter, WIDE, lambda p: rest.rlike(p))
    lead = _by_delimiter(delimiter, LEAD, lambda p: F.regexp_extract(rest, p, 0))
    closed = F.regexp_extract(_after(rest, F.length(lead)), CLOSED, 0)
    fault = F.when(wide, "too-many-columns").when(closed == "", "unclosed-quote").otherwise("text-after-quote")
    line = F.when(wide, start).otherwise(start + _lines(lead) + _lines(closed))
    return F.when(rest.isNotNull(), F.struct(fault.alias("fault"), line.cast("int").alias("line")))


def read_records(texts: DataFrame) -> DataFrame:
    """``texts`` (text, delimiter, any others) with recs and broken, in the file's row.

    recs: array of (line, rec), the records as they stand. Records are quoted as
    in RFC 4180; a quote inside a bare field is itself; empty lines are skipped
    but count. A record's line is where it starts. The first record that cannot
    be read ends them: ``broken`` is its fault and line.

    Where no record has a line end inside, lines are positions; else they are
    summed by blocks of BLOCK records, so that no file costs its square. A text
    without quotes has a record in each line, which then has no line end.
    """
    given, text, delimiter = texts.columns, F.col("text"), F.col("delimiter")
    few = _count(text, delimiter) < fixed.MAX_COLUMNS
    bare = ~text.contains(QUOTE) & (few | ~_by_delimiter(delimiter, WIDE_LINE, lambda p: text.rlike(p)))
    read = projected(texts, "width" if "width" in given else given[0], bare=F.coalesce(bare, F.lit(False)))
    lines = F.split(F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text), "\n")
    read = projected(read, "bare", lines=F.when(F.col("bare"), lines), quoted=F.when(~F.col("bare"), _quoted_records(text, delimiter)))
    numbered = F.arrays_zip(F.sequence(F.lit(1), F.size("lines")).alias("line"), F.col("lines").alias("rec"))
    numbered = F.when(F.array_contains("lines", ""), F.filter(numbered, lambda x: x["rec"] != "")).otherwise(numbered)
    return read.select(*given, F.when(F.col("bare"), numbered).otherwise(F.col("quoted.recs")).alias("recs"), F.col("quoted.broken").alias("broken"))


def _quoted_records(text: Column, delimiter: Column) -> Column:
    """Struct of recs and broken for any text, by the pattern of a record; each step is computed once."""

    def found(r: Column) -> Column:
        return of(F.struct(r.alias("found"), F.transform(r, _lines).alias("ends")), sums)

    def sums(r: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(r["ends"]) - 1) / BLOCK).cast("int"))
        each = F.when(F.array_max(r["ends"]) > 1, F.transform(blocks, lambda b: _sum(F.slice(r["ends"], b * BLOCK + 1, F.lit(BLOCK)))))
        return of(each, lambda s: of(F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b), 1)), lambda bases: records(r["found"], r["ends"], bases)))

    def records(found: Column, ends: Column, bases: Column) -> Column:
        def line(i: Column) -> Column:
            inside = F.pmod(i, F.lit(BLOCK))
            return F.when(bases.isNull(), i + 1).otherwise(F.get(bases, ((i - inside) / BLOCK).cast("int")) + _sum(F.slice(ends, i - inside + 1, inside)))

        numbered = F.transform(found, lambda r, i: F.struct(line(i).alias("line"), r.alias("rec")))
        recs = F.filter(numbered, lambda x: x["rec"] != "\n").alias("recs")
        return of(F.length(F.array_join(found, "")), lambda n: of(F.when(n < F.length(text), _after(text, n)), lambda rest: F.struct(recs, _fault(rest, delimiter, _sum(ends, 1)).alias("broken"))))

    return of(_by_delimiter(delimiter, RECORD, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))), found)


def fold_header(c: Column) -> Column:
    """D9."""
    return F.regexp_replace(F.lower(trim(c)), r"[\s\p{Z}\x{FEFF}_-]+", " ")


def may_name(rec: Column) -> Column:
    """Whether a name of each required column stands somewhere in a record; false of most rows, which need no splitting then."""
    found = [rec.rlike("(?iu)" + "|".join(a.replace(" ", r"[\s\p{Z}\x{FEFF}_-]+") for a in fixed.ALIASES[c])) for c in reversed(fixed.REQUIRED_COLUMNS)]
    return reduce(Column.__and__, found)


def _named(fields: Column, made=lambda col, f, i: col) -> Column:
    names = F.create_map(*[F.lit(x) for col, all_ in fixed.ALIASES.items() for a in all_ for x in (a, col)])
    return F.transform(fields, lambda f, i: made(F.try_element_at(names, fold_header(f)), f, i))


def name_columns(fields: Column) -> Column:
    """For each field the required column that its header names, or null, its index and the header."""
    return _named(fields, lambda col, f, i: F.struct(col.alias("col"), i.alias("i"), f.alias("header")))


def match_header(hits: Column) -> list[Column]:
    """Ok, missing (array), ambiguous (first such column), headers, and the index of each required column.

    ``hits``: a struct with, for each required column, the fields that name it.
    """
    each = {c: hits[c] for c in fixed.REQUIRED_COLUMNS}
    missing = F.array_compact(F.array(*[F.when(F.size(h) == 0, c) for c, h in each.items()]))
    twice = F.coalesce(*[F.when(F.size(h) > 1, c) for c, h in each.items()])
    headers = F.coalesce(*[F.when(F.size(h) > 1, F.transform(h, lambda x: x["header"])) for h in each.values()])
    whole = F.size(missing) == 0
    return [
        (whole & twice.isNull()).alias("ok"), missing.alias("missing"), F.when(whole, twice).alias("ambiguous"), headers.alias("headers"),
        *[F.get(h, F.lit(0))["i"].alias(c) for c, h in each.items()],
    ]


LAYOUT = "delimiter", "header_line", "width", *[f"{c}_at" for c in fixed.REQUIRED_COLUMNS], "layout_fault", "parse_fault", "parse_line", "missing", "ambiguous_column", "headers", "ways"


def _plain_header(files: DataFrame) -> DataFrame:
    """Adds plain: is this a file whose layout its first line decides alone? And d, cols: its delimiter and what each of its fields names.

    That is so where no quote and no empty line stands in the text, only one
    delimiter divides the first line and it names all columns once, and below, in
    the ten lines that are searched, no other line is a header under any
    delimiter or too wide. All other files are tried under every delimiter.
    """
    given, text, most = files.columns, F.col("text"), fixed.MAX_HEADER_SEARCH_LINES
    bare = ~text.contains(QUOTE) & ~text.contains("\n\n") & ~text.startswith("\n")
    files = projected(files, "bare", bare=F.coalesce(bare, F.lit(False)), line=F.substring_index(text, "\n", 1), head=F.substring_index(text, "\n", most))
    line, head = F.when(F.col("bare"), F.col("line")), F.when(F.col("bare"), F.col("head"))
    counts = {f"n{i}": _count(line, F.lit(d)) for i, d in enumerate(fixed.DELIMITERS)}
    narrow = reduce(Column.__and__, [_count(head, F.lit(one)) < fixed.MAX_COLUMNS for one in fixed.DELIMITERS])
    files = projected(files, "bare", **counts, searched=F.col("bare") & narrow & ~may_name(_after(head, F.length("line"))))
    divides = [F.col(c) >= len(fixed.REQUIRED_COLUMNS) - 1 for c in counts]
    d = F.coalesce(*[F.when(x, one) for x, one in zip(divides, fixed.DELIMITERS, strict=True)])
    single = (sum((x.cast("int") for x in divides), F.lit(0)) == 1) & (divides[0] | (F.col("n0") == 0))
    files = projected(files, "bare", d=F.when(F.col("bare") & F.col("searched") & single, d))
    files = projected(files, "d", cols=F.when(F.col("d").isNotNull(), _named(_bare_fields(F.col("line"), F.col("d")))))
    once_each = [F.size("cols") - F.size(F.array_remove("cols", c)) == 1 for c in fixed.REQUIRED_COLUMNS]
    plain = F.coalesce(reduce(Column.__and__, once_each), F.lit(False))
    return projected(files, "d", plain=plain).select(*given, "plain", "d", "cols")


def find_layout(decoded: DataFrame, *keep: str) -> DataFrame:
    """One row per readable file: delimiter, header_line, width, index of each column - or layout_fault and its parts.

    The delimiters are tried on the first ten records, whatever their length; exactly one header row under exactly one delimiter must name all
    three columns once. The tries are an array in the file's row, so nothing is
    shuffled. A fault beyond the tenth record is not met. Columns to ``keep`` stand
    beside; a text that is null has no layout.
    """
    return _laid_out(decoded.where(F.col("gate").isNull()).select("upload", "text", *keep)).select("upload", *keep, *LAYOUT)


def _laid_out(files: DataFrame) -> DataFrame:
    """``files`` (text, any others) with the columns of LAYOUT."""
    given, most = files.columns, fixed.MAX_HEADER_SEARCH_LINES
    files = _plain_header(files)

    def divided(c: Column, d: Column) -> Column:
        return _count(c, d) >= len(fixed.REQUIRED_COLUMNS) - 1

    def rows(t: Column, made) -> Column:
        return F.transform(t["rows"], lambda r: F.struct(r["line"], *made(r)))

    upto, text = HEAD.replace("«N»", str(most)), F.col("text")
    # A delimiter that the text has not twice divides no header and makes no record too wide.
    tried = F.filter(F.array(*map(F.lit, fixed.DELIMITERS)), lambda d: (d == fixed.DELIMITERS[0]) | divided(text, d))
    # Each step is computed once, as its results are the elements that the next one takes; none runs where the header is plain.
    tries = F.transform(tried, lambda d: F.struct(d.alias("d"), _by_delimiter(d, upto, lambda p: F.regexp_extract("text", p, 0)).alias("head")))
    tries = F.transform(tries, lambda t: F.struct(t["d"], t["head"], _by_delimiter(t["d"], HEAD_RECORD, lambda p: F.regexp_extract_all(t["head"], F.lit(p), F.lit(0))).alias("recs")))

    def records(t: Column) -> Column:
        """Only records that may name three columns, and the first by commas, of which faults speak."""

        def record(x: Column) -> Column:
            before = F.aggregate(F.slice(t["recs"], F.lit(1), x["i"]), F.lit(1), lambda n, r: n + _lines(r))
            bare = F.ltrim(x["rec"], F.lit("\n"))
            return F.struct((before + F.length(x["rec"]) - F.length(bare)).alias("line"), bare.alias("rec"))

        numbered = F.transform(t["recs"], lambda r, i: F.struct(i.alias("i"), r.alias("rec")))
        may = F.filter(numbered, lambda x: ((x["i"] == 0) & (t["d"] == fixed.DELIMITERS[0])) | (divided(x["rec"], t["d"]) & may_name(x["rec"])))
        return F.transform(may, record)

    def rest(t: Column) -> Column:
        return F.when((F.size(t["recs"]) < most) & (F.length(t["head"]) < F.length(text)), _after(text, F.length(t["head"])))

    tries = F.transform(tries, lambda t: F.struct(t["d"], rest(t).alias("rest"), (1 + _lines(t["head"])).alias("start"), records(t).alias("rows")))
    tries = F.transform(tries, lambda t: F.struct(t["d"], _fault(t["rest"], t["d"], t["start"]).alias("broken"), rows(t, lambda r: [_split(r["rec"], t["d"]).alias("tokens")]).alias("rows")))
    tries = F.transform(tries, lambda t: F.struct(t["d"], t["broken"], rows(t, lambda r: [_unquote(r["tokens"], t["d"]).alias("fields")]).alias("rows")))
    tries = F.transform(tries, lambda t: F.struct(t["d"], t["broken"], rows(t, lambda r: [F.size(r["fields"]).alias("width"), name_columns(r["fields"]).alias("named")]).alias("rows")))

    def hits(r: Column) -> Column:
        def named(c: str) -> Column:
            return F.filter(r["named"], lambda x: F.coalesce(x["col"] == c, F.lit(False)))

        return F.struct(*[named(c).alias(c) for c in fixed.REQUIRED_COLUMNS])

    tries = F.transform(tries, lambda t: F.struct(t["d"], t["broken"], rows(t, lambda r: [r["width"], hits(r).alias("hits")]).alias("rows")))
    tries = F.transform(tries, lambda t: F.struct(t["d"], t["broken"], rows(t, lambda r: [r["width"], *match_header(r["hits"])]).alias("rows")))
    tries = F.transform(tries, lambda t: F.struct(t["d"], t["broken"], F.get(t["rows"], F.lit(0)).alias("first"), F.when(t["broken"].isNull(), F.filter(t["rows"], lambda r: r["ok"])).otherwise(F.array()).alias("ok")))

    # Handed on by a generator, so that no filter on the layout repeats the tries.
    files = compiled(files, tries=F.when(~F.col("plain") & text.isNotNull(), tries))
    comma = F.get("tries", F.lit(0))
    per = projected(
        files, "plain",
        wide=F.get(F.filter("tries", lambda t: F.coalesce(t["broken"]["fault"] == "too-many-columns", F.lit(False))), F.lit(0))["broken"],
        ways=F.filter("tries", lambda t: F.size(t["ok"]) > 0),
        comma_fault=comma["broken"],
        comma_first=F.when(comma["broken"].isNull(), comma["first"]),
    )
    per = projected(per.drop("tries"), "plain", candidates=F.aggregate("ways", F.lit(0), lambda n, t: n + F.size(t["ok"])), only=F.get("ways", F.lit(0)))
    at, plain = F.get("only.ok", F.lit(0)), F.col("plain")
    one = F.col("wide").isNull() & (F.col("candidates") == 1)
    kind = (
        F.when(plain | text.isNull(), None).when(F.col("wide").isNotNull(), "parse-error").when(F.col("candidates") == 1, None).when(F.col("candidates") > 1, "ambiguous")
        .when(F.col("comma_fault").isNotNull(), "parse-error").when(F.col("comma_first").isNull(), "empty").otherwise("bad-header")
    )
    broken = F.when(kind == "parse-error", F.coalesce("wide", "comma_fault"))

    def index(c: str) -> Column:
        return F.when(plain, (F.array_position("cols", c) - 1).cast("int")).when(one, at[c])

    # By commas, a plain header of other delimiters is one field that names nothing.
    missing = F.when(F.col("d") == fixed.DELIMITERS[0], F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, fixed.REQUIRED_COLUMNS)))
    ways = F.transform("ways", lambda t: F.struct(t["d"].alias("delimiter"), F.transform(t["ok"], lambda r: r["line"]).alias("ok_lines")))
    return per.select(
        *given,
        F.when(plain, F.col("d")).when(one, F.col("only.d")).alias("delimiter"), F.when(plain, 1).when(one, at["line"]).alias("header_line"), F.when(plain, F.size("cols")).when(one, at["width"]).alias("width"),
        *[index(c).alias(f"{c}_at") for c in fixed.REQUIRED_COLUMNS],
        kind.alias("layout_fault"), broken["fault"].alias("parse_fault"), broken["line"].alias("parse_line"),
        F.when(plain, missing).otherwise(F.col("comma_first.missing")).alias("missing"), F.col("comma_first.ambiguous").alias("ambiguous_column"), F.col("comma_first.headers").alias("headers"),
        F.when(plain, F.array(F.struct(F.col("d").alias("delimiter"), F.array(F.lit(1)).alias("ok_lines")))).otherwise(ways).alias("ways"),
    )


def _counted(texts: DataFrame, cap: int) -> DataFrame:
    """``texts`` (text, layout, any others) with file_fault, broken and data: the records below the header, of files without a fault."""
    kept = [c for c in texts.columns if c != "text"]
    # The first line is the first record, so where lines are records no header needs a search.
    below = F.filter("recs", lambda x: x["line"] > F.col("header_line"))
    even = F.get("recs", F.size("recs") - 1)["line"] == F.size("recs")
    below = F.when(even, F.slice("recs", F.col("header_line") + 1, F.size("recs"))).otherwise(below)
    read = projected(read_records(texts).drop("text"), "header_line", data=below)
    n = F.size("data")
    fault = F.when(n > cap, "too-many-rows").when(F.col("broken").isNotNull(), "parse").when(n == 0, "no-data-rows")
    read = compiled(read.drop("recs"), file_fault=fault)
    parse = F.when(F.col("file_fault") == "parse", F.col("broken"))
    return read.select(*kept, "file_fault", parse.alias("broken"), F.when(F.col("file_fault").isNull(), F.col("data")).alias("data"))


def read_files(decoded: DataFrame, cap: int = fixed.MAX_DATA_ROWS) -> DataFrame:
    """D11-D15 in the file's row, so that no text is shuffled and none meets its layout again.

    ``decoded`` without text and content, with the columns of LAYOUT, file_fault (as in ``data_rows``)
    and data, from which ``rows_of`` makes rows; parse_fault and parse_line are those of the layout, or of the records.
    """
    files = decoded.drop("content").withColumn("text", F.when(F.col("gate").isNull(), F.col("text")))
    read = _counted(_laid_out(files), cap)
    return read.withColumns({f"parse_{c}": F.coalesce(f"parse_{c}", F.col("broken")[c]) for c in ("fault", "line")}).drop("broken")


def rows_of(read: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """Rows for ``read_cells`` of files as ``read_files`` gives them; with ``outer`` one of nulls for a file without any."""
    layout = ("delimiter", "width", *[f"{c}_at" for c in fixed.REQUIRED_COLUMNS])
    each = read.select("upload", *keep, *layout, (F.inline_outer if outer else F.inline)("data"))
    rec = F.col("rec")
    each = projected(each, "quoted", quoted=rec.contains(QUOTE), tokens=F.when(rec.contains(QUOTE), _split(rec, F.col("delimiter"))))
    bare = _bare_fields(F.when(rec.endswith("\n"), F.substring(rec, F.lit(1), F.length(rec) - 1)).otherwise(rec), F.col("delimiter"))
    each = projected(each, "quoted", quoted=F.col("quoted"), fields=F.when(F.col("quoted"), _unquote(F.col("tokens"), F.col("delimiter"))).otherwise(bare))
    return each.select(
        "upload", *keep, "line", *[F.coalesce(F.get("fields", F.col(f"{c}_at")), F.lit("")).alias(c) for c in fixed.REQUIRED_COLUMNS],
        F.size("fields").alias("actual"), F.col("width").alias("expected"),
    )


def data_rows(decoded: DataFrame, layout: DataFrame, cap: int = fixed.MAX_DATA_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows for read_cells; files: upload, file_fault, parse_fault, parse_line).

    file_fault: too-many-rows (the parsed records pass ``cap``), else parse, else
    no-data-rows. Records are counted in the file's row and come apart only in
    files without a fault; text meets layout in the one shuffle by upload, as layouts
    grow with the files and are never broadcast. ``read_files`` needs no such join.
    """
    found = layout.where(F.col("delimiter").isNotNull()).select("upload", "delimiter", "header_line", "width", "product_at", "date_at", "weight_at")
    read = _counted(decoded.select("upload", "text").join(found.hint("merge"), "upload"), cap)
    files = read.select("upload", "file_fault", F.col("broken")["fault"].alias("parse_fault"), F.col("broken")["line"].alias("parse_line"))
    return rows_of(read), files


def unreadable_reason() -> Column:
    """why no row was read from a file, or null; of the columns that ``describe_unreadable`` takes."""
    gate, layout, later, parse = (F.col(c) for c in ("gate", "layout_fault", "file_fault", "parse_fault"))
    return (
        F.when((gate == "too-large") | (later == "too-many-rows") | (parse == "too-many-columns"), "too_large")
        .when(gate.isin("empty", "blank") | (layout == "empty") | (later == "no-data-rows"), "empty")
        .when(gate.isNotNull() | parse.isNotNull(), "unparseable").when(layout.isin("ambiguous", "bad-header"), "bad_columns")
    )


def describe_unreadable(files: DataFrame, cap: int = fixed.MAX_DATA_ROWS) -> DataFrame:
    """upload, reason, summary, detail of files that no row was read from.

    ``files``: upload, size, gate, control_code, control_offset, layout_fault,
    missing, ambiguous_column, headers, ways, file_fault, parse_fault, parse_line.
    """
    label = F.create_map(*[F.lit(x) for pair in fixed.HEADER_LABELS.items() for x in pair])
    gate, layout, later, parse = (F.col(c) for c in ("gate", "layout_fault", "file_fault", "parse_fault"))
    broken = parse.isNotNull()
    line = F.col("parse_line").cast("string")
    empty = "That file has no rows in it."
    reason = unreadable_reason()
    quoted = F.transform("headers", lambda h: F.concat(F.lit('"'), h, F.lit('"')))
    summary = (
        F.when(gate == "too-large", f"That file is larger than {fixed.MAX_UPLOAD_MEGABYTES}MB.")
        .when(gate.isin("empty", "blank") | (layout == "empty"), empty)
        .when(gate == "signature-xlsx", "That looks like an Excel (.xlsx) file, not a CSV. Save it as CSV and upload it again.")
        .when(gate == "signature-xls", "That looks like an old Excel (.xls) file, not a CSV. Save it as CSV and upload it again.")
        .when(gate == "control-character", "That file does not look like text. Save it as CSV (comma separated values) and upload it again.")
        .when(parse == "unclosed-quote", F.concat(F.lit("The quotes starting on line "), line, F.lit(" are never closed, so we cannot tell where that row ends.")))
        .when(parse == "text-after-quote", F.concat(F.lit("Line "), line, F.lit(" has text after a closing quote. A quoted value has to fill the whole cell.")))
        .when(parse == "too-many-columns", f"That file has more than {fixed.MAX_COLUMNS} columns, far past what we can read.")
        .when(layout == "ambiguous", "We can't tell what separates your columns — this file could be split into columns more than one way. Save it as CSV (comma separated values) and upload it again.")
        .when((layout == "bad-header") & (F.size("missing") > 0), F.concat(F.lit("Your file needs a column for "), list_of(F.transform("missing", lambda c: F.element_at(label, c))), F.lit(".")))
        .when(layout == "bad-header", F.concat(F.lit("Two columns could be the "), F.element_at(label, F.col("ambiguous_column")), F.lit(": "), list_of(quoted), F.lit(". Remove or rename one.")))
        .when(later == "no-data-rows", "That file has a header but no rows under it.")
        .when(later == "too-many-rows", F.concat(F.lit("That file has more than "), group_digits(F.lit(cap)), F.lit(" rows.")))
    )
    shown = F.create_map(*[F.lit(x) for d in fixed.DELIMITERS for x in (d, '"\\t"' if d == "\t" else f'"{d}"')])
    ways = F.flatten(F.transform("ways", lambda w: F.transform(w["ok_lines"], lambda ln: F.concat(F.element_at(shown, w["delimiter"]), F.lit(" at line "), ln.cast("string")))))
    detail = (
        F.when(gate == "too-large", F.concat(F.col("size").cast("string"), F.lit(" bytes")))
        .when(gate.startswith("signature"), F.concat(F.lit("signature matched "), F.substring(gate, 11, 4)))
        .when(gate == "control-character", F.concat(F.lit("control character 0x"), F.lower(F.hex("control_code")), F.lit(" at offset "), F.col("control_offset").cast("string")))
        .when(broken, F.concat(parse, F.lit(" at line "), line))
        .when(layout == "ambiguous", F.array_join(ways, " and "))
        .when((layout == "bad-header") & (F.size("missing") > 0), F.concat(F.lit("missing column(s): "), F.array_join("missing", ", ")))
        .when(layout == "bad-header", F.concat(F.lit("ambiguous column: "), "ambiguous_column", F.lit(" ("), F.array_join("headers", " | "), F.lit(")")))
    )
    return files.where(reason.isNotNull()).select("upload", reason.alias("reason"), summary.alias("summary"), detail.alias("detail"))


def write_out(cells: DataFrame) -> DataFrame:
    """Files built from rows of upload, line, product, date, weight: upload, content, size.

    Delimiter and encoding vary with the upload; fields are quoted where needed.
    """
    d = F.element_at(F.array(*map(F.lit, fixed.DELIMITERS)), F.pmod("upload", F.lit(4)).cast("int") + 1)

    def field(c: str) -> Column:
        v = F.col(c)
        return F.when(v.contains('"') | v.contains("\n") | v.contains(F.col("d")), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    rows = cells.withColumn("d", d)
    record = F.concat(field("product"), F.col("d"), field("date"), F.col("d"), field("weight"))
    packed = rows.groupBy("upload", "d").agg(F.sort_array(F.collect_list(F.struct("line", record.alias("t")))).alias("ls"))
    head = F.concat(F.lit("Item_Name"), F.col("d"), F.lit("order date"), F.col("d"), F.lit(" WEIGHT "))
    text = F.concat(head, F.lit("\n"), F.array_join("ls.t", "\n"), F.lit("\n"))
    which = F.pmod("upload", F.lit(7))
    content = (
        F.when(which == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(which == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")))
        .when(which == 2, F.encode(F.replace(text, F.lit("\n"), F.lit("\r\n")), "UTF-8"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return packed.select("upload", content.alias("content")).withColumn("size", F.length("content"))
