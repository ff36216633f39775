"""Raking against a plain loop: both plans, targets met only in the limit, contradictory targets."""

import math

import pytest

from larder.llm import mixing

CELLS = "source string, lang string, tokens long"


def plain(cells, targets, rounds):
    """The weights after so many rounds, and how far each cell's values stay from their targets."""
    w = [float(c[-1]) for c in cells]
    for _ in range(rounds):
        for i, t in enumerate(targets):
            sums = {}
            for c, x in zip(cells, w):
                sums[c[i]] = sums.get(c[i], 0.0) + x
            w = [x * t.get(c[i], 0.0) / sums[c[i]] if sums[c[i]] else 0.0 for c, x in zip(cells, w)]
    missed = []
    for c in cells:
        missed.append(max(abs(sum(x for d, x in zip(cells, w) if d[i] == c[i]) - t.get(c[i], 0.0)) for i, t in enumerate(targets)))
    return w, missed


def raked(spark, cells, targets, **more):
    tables = {f: spark.createDataFrame(list(t.items()), f"{f} string, target double") for f, t in zip(("source", "lang"), targets)}
    found = {(r["source"], r["lang"]): r for r in mixing.rake(spark.createDataFrame(cells, CELLS), tables, **more).collect()}
    return [found[c[:2]] for c in cells]


@pytest.mark.parametrize("few_bytes", [mixing.FEW_BYTES, 0])
def test_both_plans_rake_alike(spark, few_bytes):
    cells = [(s, x, 3 + 5 * i) for i, (s, x) in enumerate((s, x) for s in ("a", "b", None) for x in ("c", "d"))]
    targets = {"a": 0.2, "b": 0.8}, {"c": 0.4, "d": 0.6}
    got, (weight, missed) = raked(spark, cells, targets, most=3, few_bytes=few_bytes), plain(cells, targets, 3)
    for r, w, m in zip(got, weight, missed):
        assert math.isclose(r["weight"], w, abs_tol=1e-12) and math.isclose(r["missed"], m, abs_tol=1e-12)
    met = raked(spark, cells, targets, few_bytes=few_bytes)
    assert max(r["missed"] for r in met) <= 1e-9 and all(r["weight"] == 0 for r in met[4:])


def test_targets_met_only_in_the_limit_show_what_they_miss(spark):
    cells = [("a", "c", 0), ("a", "d", 10), ("b", "c", 10), ("b", "d", 10)]
    targets = {"a": 0.5, "b": 0.5}, {"c": 0.5, "d": 0.5}
    got, (weight, missed) = raked(spark, cells, targets), plain(cells, targets, mixing.MOST_ROUNDS)
    assert all(math.isclose(r["weight"], w, abs_tol=1e-9) and math.isclose(r["missed"], m, abs_tol=1e-9) for r, w, m in zip(got, weight, missed))
    assert 1e-4 < max(missed) < 0.0025


def test_contradictory_targets_end_and_show(spark):
    got = raked(spark, [("a", "c", 5), ("b", "d", 5)], ({"a": 0.3, "b": 0.7}, {"c": 0.6, "d": 0.4}))
    assert all(math.isclose(r["missed"], 0.3, abs_tol=1e-9) for r in got)
    lost = raked(spark, [("a", "c", 5), ("b", "c", 5)], ({"a": 0.5, "x": 0.5}, {"c": 1.0}))
    assert math.isclose(lost[0]["missed"], 0.5, abs_tol=1e-9) and lost[1]["weight"] == 0
