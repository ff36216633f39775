"""Benchmark decontamination through a positional inverted index of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.shared import ascii_lower, documents, settle, small, table, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
SLOP = 8
LISTS = 3
"""How many of a window's rarest terms have their postings stored and intersected."""


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows: wid, w, len; members: wid, item_id), each distinct word sequence once.

    An item with fewer words than ``width``, but not none, is one window.
    """
    w = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("w"))
    each = settle(each.select("item_id", "w", F.sha2(F.concat_ws(" ", "w"), 256).alias("wid")).distinct(), "windows")
    windows = each.select("wid", "w", F.size("w").alias("len")).dropDuplicates(["wid"])
    return windows, each.select("wid", "item_id").distinct()


def item_sets(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, sid of every window; sid, ids of every distinct set of items, as strings).

    Windows of the same items share a set, so a document meets each set once,
    however many items repeat a text. Null item ids are in no set.
    """
    owned = members.groupBy("wid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    owned = settle(owned.withColumn("sid", F.sha2(F.to_json("ids"), 256)), "item-sets")
    return owned.select("wid", "sid"), owned.select("sid", "ids").dropDuplicates(["sid"])


def items_of(found: DataFrame, sets: tuple[DataFrame, DataFrame]) -> DataFrame:
    """doc_id, h, items (distinct, sorted as strings) from the windows found in each text: wid, doc_id, h."""
    of_window, ids = sets
    met = found.join(small(of_window), "wid").select("doc_id", "h", "sid").distinct().join(small(ids), "sid")
    return met.groupBy("doc_id", "h").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))


def _terms(docs: DataFrame) -> DataFrame:
    """One row for each word of each document: doc_id, h, pos, term. (doc_id, h) names the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(words(F.col("text"))).alias("pos", "term"))


def rarest_terms(docs: DataFrame, windows: DataFrame, lists: int = LISTS) -> DataFrame:
    """wid, len, term, offset, rank: each window's rarest terms in the corpus, rarest first.

    Counts cover every document. A window with a term that the corpus lacks
    cannot occur and has no rows.
    """
    each = windows.select("wid", "len", F.posexplode("w").alias("offset", "term"))
    each = each.groupBy("wid", "len", "term").agg(F.min("offset").alias("offset"))
    vocabulary = settle(each.select("term").distinct(), "vocabulary")
    counts = _terms(docs).join(small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = settle(counts, "term-counts")
    lacking = each.join(small(counts), "term", "left_anti").select("wid").distinct()
    order = Window.partitionBy("wid").orderBy("n", "term")
    return (
        each.join(small(counts), "term")
        .join(lacking, "wid", "left_anti")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= lists)
        .select("wid", "len", "term", "offset", "rank")
    )


def index_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional inverted index: term, doc_id, h, pos for the given terms, stored in the shared folder."""
    return settle(_terms(docs).join(small(terms.select("term").distinct()), "term").distinct(), "postings")


def intersect(postings: DataFrame, rare: DataFrame, lists: int = LISTS) -> DataFrame:
    """wid, len, doc_id, h, start: where the lists of a window's rarest terms agree after taking off their offsets."""
    at = ["wid", "doc_id", "h", "start"]

    def entries(rank: int) -> DataFrame:
        own = rare.where(F.col("rank") == rank).select("wid", "len", "term", "offset")
        found = postings.join(small(own), "term").withColumn("start", F.col("pos") - F.col("offset"))
        return found.where(F.col("start") >= 0).select(*at, "len")

    found = entries(1)
    for rank in range(2, lists + 1):
        short = rare.groupBy("wid").agg(F.max("rank").alias("have")).where(F.col("have") < rank).select("wid")
        kept = _same(found, entries(rank), at)
        found = kept.unionByName(found.join(small(short), "wid", "left_semi")) if rank > 1 else kept
    return found


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """A join that lets null identifiers meet."""
    a, b = left.alias("a"), right.alias("b")
    cond = F.lit(True)
    for c in on:
        cond &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, cond, how).select("a.*")


def exact_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, lists: int = LISTS) -> tuple[DataFrame, ...]:
    """(matches: wid, len, doc_id, h, start; members: wid, item_id; the index's postings; the windows' rarest terms).

    The candidates of the index are compared word by word with the texts of
    their documents.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    windows, members = benchmark_windows(benchmark, width)
    rare = settle(rarest_terms(docs, windows, lists), "rarest-terms")
    postings = index_postings(docs, rare)
    found = settle(intersect(postings, rare, lists), "candidates")
    per_doc = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("wid", "len", "start")).alias("at"))
    texts = docs.withColumn("h", F.xxhash64("text")).alias("b")
    per_doc = small(settle(per_doc, "candidates-by-document")).alias("a")
    met = texts.join(per_doc, F.col("a.h").eqNullSafe(F.col("b.h")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")))
    seen = met.select("b.doc_id", "b.h", words(F.col("b.text")).alias("w"), "a.at")
    sliced = F.transform(
        "at",
        lambda x: F.struct(x["wid"], x["len"], x["start"], F.sha2(F.array_join(F.slice("w", x["start"] + 1, x["len"]), " "), 256).alias("is")),
    )
    equal = F.filter(sliced, lambda x: x["is"] == x["wid"])
    matches = seen.select("doc_id", "h", F.explode(equal).alias("m"))
    return settle(matches.select("m.wid", "m.len", "doc_id", "h", "m.start").distinct(), "matches"), members, postings, rare


def near_windows(postings: DataFrame, rare: DataFrame, slop: int = SLOP) -> DataFrame:
    """wid, doc_id, h: texts where a window's two rarest terms stand within ``slop`` words of their distance in it.

    A window of one distinct term is near wherever the term stands. Positions
    meet by bins of ``slop`` words and their neighbours, so work follows the
    postings rather than all pairs of positions.
    """
    lists = []
    for rank in (1, 2):
        own = rare.where(F.col("rank") == rank).select("wid", "term", "offset")
        lists.append(
            postings.join(small(own), "term").select("wid", "doc_id", "h", (F.col("pos") - F.col("offset")).alias("start"))
        )
    single = rare.groupBy("wid").agg(F.max("rank").alias("have")).where("have = 1").select("wid")
    alone = lists[0].join(small(single), "wid", "left_semi").select("wid", "doc_id", "h")
    bins = F.floor(F.col("start") / (slop + 1))
    a = lists[0].withColumn("bin", F.explode(F.array(bins - 1, bins, bins + 1))).alias("a")
    b = lists[1].withColumn("bin", bins).alias("b")
    cond = F.abs(F.col("a.start") - F.col("b.start")) <= slop
    for c in ("wid", "doc_id", "h", "bin"):
        cond &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, cond, "left_semi").select("a.wid", "a.doc_id", "a.h").unionByName(alone).distinct()


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, width: int = WINDOW) -> DataFrame:
    """doc_id, item_id: documents near a window of the item, as ``near_windows`` tells."""
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    windows, members = benchmark_windows(benchmark, width)
    rare = settle(rarest_terms(docs, windows, 2), "rarest-terms")
    near = near_windows(index_postings(docs, rare), rare, slop)
    return near.select("wid", "doc_id").join(small(members), "wid").select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20, near: bool = False) -> DataFrame:
    """One row per input row: doc_id, h, n_words, n_hit, items (sorted as strings), contaminated; with ``near`` also n_near.

    A word is hit if any occurrence of a benchmark window covers it; a document
    is contaminated if ``share`` * n_hit >= n_words > 0 and n_hit > 0. A null text
    has no words. Rows that repeat an identifier and its text get equal results.
    Empty tables, on either side, give no hits; other columns are ignored. n_near
    counts the items that have a window near (``near_windows``), exact ones too.
    """
    matches, members, postings, rare = exact_matches(docs, benchmark, width)
    key = ["doc_id", "h"]
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    sets = item_sets(members)
    items = items_of(matches, sets)
    found = hits.alias("a").join(items.alias("b"), F.col("a.h").eqNullSafe(F.col("b.h")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    found = settle(found.select("a.doc_id", "a.h", "n_hit", "items"), "hits")
    counted = docs.select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"),
    ).alias("a")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    extra = []
    if near:
        close = items_of(near_windows(postings, rare), sets).select(*key, F.size("items").alias("n_near"))
        close = small(settle(close, "near-items")).alias("c")
        met = F.col("a.h").eqNullSafe(F.col("c.h")) & F.col("a.doc_id").eqNullSafe(F.col("c.doc_id"))
        counted = counted.join(close, met, "left").select("a.*", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")).alias("a")
        extra = ["n_near"]
    return counted.join(
        small(found).alias("b"), F.col("a.h").eqNullSafe(F.col("b.h")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left"
    ).select(
        "a.doc_id",
        "a.h",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        *extra,
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names."""
    found = contamination(docs, benchmark).where("contaminated").select("doc_id", "h").distinct()
    gone = small(settle(found, "contaminated")).alias("g")
    h = unused(docs, "h")
    keyed = docs.withColumn(h, F.xxhash64("text")).alias("d")
    met = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{h}") == F.col("g.h"))
    return keyed.join(gone, met, "left_anti").select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), near=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
    )


QUERIES = {"op1_decontaminate": op1_decontaminate}

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE_SQL = {
    "op1_decontaminate": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, w[i:i + 12] AS win
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS r(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT len(win) AS k FROM bw),
occ AS (
  SELECT doc_id, i, k, w[i:i + k - 1] AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM occ JOIN bw USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1),
-- near: the two rarest terms of a window, by occurrences in the corpus, then by name
wt AS (
  SELECT win, term, min(o) AS o FROM (SELECT win, unnest(win) AS term, generate_subscripts(win, 1) AS o FROM (SELECT DISTINCT win FROM bw)) GROUP BY ALL),
pos AS (SELECT doc_id, term, p FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d) WHERE term IN (SELECT term FROM wt)),
freq AS (SELECT term, count(*) AS n FROM pos GROUP BY 1),
ranked AS (
  SELECT win, term, o, row_number() OVER (PARTITION BY win ORDER BY n, term) AS rank, count(*) OVER (PARTITION BY win) AS have
  FROM wt JOIN freq USING (term) WHERE win NOT IN (SELECT win FROM wt WHERE term NOT IN (SELECT term FROM freq))),
l1 AS (SELECT doc_id, win, have, p - o AS s FROM ranked JOIN pos USING (term) WHERE rank = 1),
l2 AS (SELECT doc_id, win, p - o AS s FROM ranked JOIN pos USING (term) WHERE rank = 2),
close AS (
  SELECT doc_id, win FROM l1 WHERE have = 1
  UNION SELECT l1.doc_id, l1.win FROM l1 JOIN l2 ON l1.doc_id = l2.doc_id AND l1.win = l2.win AND abs(l1.s - l2.s) <= 8),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN bw USING (win) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""
}
