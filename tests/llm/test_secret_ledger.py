"""Secret scans against a matcher written by hand, and what the ledger keeps from being scanned."""

import hashlib
import random

from larder.llm import secrets

WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
UPPER, HEX = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")


def _run(text, at, chars):
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def _assign(text, i):
    """End of the match at i and of its value's length, or None."""
    for word in WORDS:
        if all(c.isascii() and c.lower() == w for c, w in zip(text[i : i + len(word)], word)) and len(text) >= i + len(word):
            at = i + len(word)
            at += text[at : at + 1] in ("'", '"')
            at = _run(text, at, " ")
            if text[at : at + 1] not in (":", "="):
                continue
            at = _run(text, at + 1, " ")
            at += text[at : at + 1] in ("'", '"')
            end = _run(text, at, VALUE)
            if end > at:
                return end, end - at
    return None


def base(text):
    found, i = [], 0
    while i < len(text):
        if hit := _assign(text, i):
            if hit[1] >= 12:
                found.append((i, 0, f"assign:{i}:{hit[0]}"))
            i = hit[0]
        else:
            i += 1
    for n, (kind, head, chars, least) in enumerate([("access", "AKIA", UPPER, 18), ("hex", "", HEX, 16)], 1):
        i = 0
        while i < len(text):
            end = _run(text, i + len(head), chars) if text.startswith(head, i) else i
            if end > i + len(head):
                if end - i >= least:
                    found.append((i, n, f"{kind}:{i}:{end}"))
                i = end
            else:
                i += 1
    return [x for _, _, x in sorted(found)]


PIECES = ["password", "PassWD", "secret", "tokEn", "api_key", "apikey", "ſecret", "toKen", '"', "'", " ", ":", "=", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "ABCDEFGHIJ", "abcdefghijkl", "Zz9+/_", "é", "\n", "\U0001f600"]


def _texts(n):
    draw = random.Random(7)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def _base_of(findings):
    return [f"{k}:{s}:{e}" for k, s, e in findings if k in secrets.KINDS[:3]]


def test_base_rules_by_hand():
    assert sum(len(base(t)) for t in _texts(4000)) > 1000
    for text in _texts(4000):
        assert _base_of(secrets.find_secrets(text)) == base(text), text


def test_query_and_ledger_by_hand(spark):
    texts = _texts(300) + ["x" * 3_000_000 + " token=abcdefghijklmnop", None, ""]
    rows = [(i % 300 if i % 11 else None, i, texts[i % len(texts)], "extra") for i in range(900)]
    df = spark.createDataFrame(rows, "path int, version int, text string, findings string")
    got = {r["version"]: _base_of(r["findings"]) for r in secrets.scan_in_two(df).collect()}
    assert got == {v: base(t or "") for _, v, t, _ in rows}
    assert secrets.scan_in_two(df.limit(0)).count() == 0


def test_only_unseen_blobs_are_scanned(spark):
    old, new = "token = oldoldoldoldold", "token = newnewnewnewnew"
    mark = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ledger = spark.createDataFrame([(mark(old), secrets.RULE_VERSION, [("hex", 1, 2)]), (mark(new), "1", [])], f"blob string, rule_version string, findings {secrets.FINDING}")
    df = spark.createDataFrame([("a", 1, old), ("b", 1, old), ("b", 2, new)], "path string, version int, text string")
    located, after = secrets.scan_history(df, ledger)
    assert {(r["path"], r["version"], *_base_of(r["findings"])) for r in located.collect()} == {("a", 1, "hex:1:2"), ("b", 1, "hex:1:2"), ("b", 2, "assign:0:23")}
    assert after.count() == 3


def test_paths_of_hot_blobs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "is_small", lambda df: False)
    df = spark.range(3000).selectExpr("id AS path", "1 AS version", "if(id % 3 = 0, 'token = abcdefghijklmnop', concat('text ', id)) AS text")
    found = secrets.scan_in_two(df).collect()
    assert len(found) == 3000 and sum(len(r["findings"]) for r in found) == 1000
