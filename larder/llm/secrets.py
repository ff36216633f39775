"""Secret scans through an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.shared import documents, is_small, settle

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "private_key", "github", "jwt"]
"""In the order of their listing; the first three are the base rules."""
RULE_VERSION = "2"

SALTS = 16
"""Parts of the paths of one blob where its findings are too many to broadcast."""

FINDING = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding in code points, by start, then kind as listed.

    Matches are leftmost and do not overlap within a kind. An assignment needs a
    value of 12 characters or more; a shorter one is dropped but still consumed.
    """
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(kind, m.start(), m.end()) for kind, pattern in _OTHERS for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_OTHERS = [
    ("access", re.compile(r"AKIA[A-Z0-9]{14,}")),
    ("hex", re.compile(r"[0-9a-f]{16,}")),
    ("private_key", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
]
_MAYBE = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""
    r"""|-----BEGIN |gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8}"""
)
"""What every text with a finding contains; the other blobs are entered in the ledger without a scan by Python."""


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [
            [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] if t else []
            for t in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], ["blob", "findings"])


def _to_paths(rows: DataFrame, known: DataFrame, salts: int) -> DataFrame:
    """``rows`` with the findings of their blobs: broadcast by counted bytes, else each blob's paths in ``salts`` parts."""
    found = settle(known.where(F.size("findings") > 0), "secret-findings")
    if is_small(found):
        met = rows.join(F.broadcast(found), "blob", "left")
    else:
        salt = F.pmod(F.xxhash64("path", "version"), F.lit(salts)).cast("int")
        parts = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("salt", salt).join(parts, ["blob", "salt"], "left")
    return met.select("path", "version", "blob", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def scan_history(
    versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, salts: int = SALTS
) -> tuple[DataFrame, DataFrame]:
    """Scan the blobs that the ledger has not seen under this rule version.

    ``versions``: path, version, text - one row for every historical version of a
    path, with any further columns ignored. ``ledger``: blob, rule_version,
    findings, as returned before. Returns (findings for every row of
    ``versions``: path, version, blob, findings; the ledger with the new entries).

    A blob is the SHA-256 of the text; a null text is the empty blob. Equal texts
    are scanned once however many paths have them; rows that repeat a path and
    version all come back. A text is scanned whole, in one piece, whatever its
    length. An empty table gives an empty result and an unchanged ledger; an
    entry that the ledger holds twice counts once.
    """
    rows = versions.select("path", "version", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "blob", F.sha2("text", 256)
    )
    new = rows.where(F.col("text").rlike(_MAYBE)).select("blob", "text")
    seen = None
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob", "findings").dropDuplicates(["blob"])
        new = new.join(seen.select("blob"), "blob", "left_anti")
    # One text for each blob, combined before the shuffle, so that a blob under many paths is no hot key.
    scanned = settle(new.groupBy("blob").agg(F.max("text").alias("text")).mapInArrow(_scan, f"blob string, findings {FINDING}"), "secret-scan")
    located = _to_paths(rows.select("path", "version", "blob"), scanned if seen is None else scanned.unionByName(seen), salts)
    entries = rows.select("blob").distinct()
    if seen is not None:
        entries = entries.join(seen.select("blob"), "blob", "left_anti")
    entries = entries.join(scanned, "blob", "left").select(
        "blob", F.lit(rule_version).alias("rule_version"), F.coalesce("findings", F.array().cast(FINDING)).alias("findings")
    )
    return located, entries if ledger is None else ledger.select("blob", "rule_version", "findings").unionByName(entries)


def scan_in_two(versions: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every row, as two runs of the ledger: a first half of the paths, then the rest against its ledger.

    The halves go by a hash of the path; a null path is in the first. Texts of
    the first half are not scanned again in the second.
    """
    early = F.pmod(F.coalesce(F.crc32(F.col("path").cast("string")), F.lit(0)), F.lit(2)) == 0
    first, ledger = scan_history(versions.where(early), None, rule_version)
    second, _ = scan_history(versions.where(~early), settle(ledger, "secret-ledger"), rule_version)
    return first.unionByName(second)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    located = scan_in_two(docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text"))

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(findings):
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = F.filter("findings", lambda f: f["kind"].isin(KINDS[:3]))
    return located.select(
        F.col("path").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("findings")).alias("spans"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE_SQL: dict[str, str] = {}
