"""Repair of conversations against an exact search over all cheapest edits, row by row in plain Python."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush
from itertools import product

import pytest

from larder.llm import repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def search(rows):
    """(cost, audit, turns) by Dijkstra over (cost, audit) itself: the first at the end is the cheapest, then the least."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, turns = heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, turns
        if (k, state) in seen:
            continue
        seen.add((k, state))
        give = "user" if NEXT[state] == "u" else "assistant"
        heappush(heap, (cost + 2, audit + "I", k, give[0], (*turns, f"{give}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heappush(heap, (cost + 3, audit + "D", k + 1, state, turns))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] == NEXT[state] or role[:1] == "s" and state == "":
                    heappush(heap, (cost + more, audit + "K", k + 1, role[:1], (*turns, f"{role}:{text}")))
                heappush(heap, (cost + 2 + more, audit + "R", k + 1, give[0], (*turns, f"{give}:{text}")))
    raise AssertionError


def brute(rows, harm=True):
    out, kept = {}, {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if harm else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in own:
            said = text.strip(" \t\n\v\f\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        pairs = [(a[0][:1] + b[0][:1]) for a, b in zip(marked, marked[1:], strict=False)]
        cost, audit, result = search(marked) if marked else (0, "", ())
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest(),
        )
    return out


def ours(spark, rows, harm=True):
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int")
    found = repair.repair(df, repair.damaged(df) if harm else None)
    assert found.columns == ["conv_id", *repair.COUNTS, "audit", "repaired_sha256"]
    collected = found.collect()
    assert len({r.conv_id for r in collected}) == len(collected)
    return {r.conv_id: tuple(r)[1:] for r in collected}


def corpus(seed, lengths):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "open", "", " \n", "Why? ", "é.", "a.b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User"]
    rows = []
    for conv, n in enumerate(lengths):
        for turn in range(n):
            said = rng.choice(texts) if rng.random() < 0.5 else f"turn {turn}."
            role = roles[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, turn + (turn > 4), None if rng.random() < 0.03 else role, None if rng.random() < 0.03 else said))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("harm", [True, False])
def test_equals_search(spark, harm):
    rows = corpus(1, [1, 2, 3, 4, 5, 6, 7, 8] * 12) + [(None, 0, "user", "Hi."), (None, None, "assistant", "x"), (500, None, None, None), (501, 3, "user", "Q."), (501, 3, "user", "Q."), (501, 3, "assistant", "A.")]
    assert ours(spark, rows, harm) == brute(rows, harm)


@pytest.mark.parametrize("bits", [2, 6])
def test_long_conversations_in_segments(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = corpus(2, [3, 400, 5, 130, 64, 1]) + [(90, 0, "user", "same.")] * 200
    assert ours(spark, rows) == brute(rows)


def test_auction_is_cheapest_and_least():
    for n in range(1, 5):
        for codes in product("suaxSUA-", repeat=n):
            rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), str(i), "blank" if c == "-" else "truncated" if c.isupper() else None) for i, c in enumerate(codes)]
            cost, letters, _ = search(rows)
            found, path = repair.auction("".join(codes), repair.START, repair.FINAL)
            assert (found, "".join(x for x, _ in path)) == (cost, letters)


def test_empty_table(spark):
    assert ours(spark, []) == {}


def test_query_whole_table(spark):
    from conftest import DATA

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, DATA).collect()} == brute(rows)
