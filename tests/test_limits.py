"""Rolling limits, audits and error classes against their SQL twins and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import access, documents
from larder.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["q_allowance", "q_rate_breaks", "i_checks", "i_vocabulary", "i_unique", "i_foreign", "j_reasons"])
def test_twin(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["q_rate_breaks", "i_vocabulary", "i_unique", "i_foreign", "j_reasons"])
def test_finds_every_kind(duck, name):
    column = {"q_rate_breaks": "what", "j_reasons": "reason"}.get(name, '"table"')
    want = {"q_rate_breaks": 3, "j_reasons": 3, "i_vocabulary": 7, "i_unique": 10, "i_foreign": 9}[name]
    assert duck.execute(f"SELECT count(DISTINCT {column}) FROM ({ORACLE_SQL[name]}) x").fetchone()[0] == want


def test_rolling_counts(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.randint(0, 3000)) for i in range(400)] + [(400, 3, 5), (401, 3, 5)]
    df = spark.createDataFrame(rows, "id long, org long, t long").withColumn("at", F.timestamp_seconds("t"))
    got = {r.id: (r.org, r.a, r.b) for r in access.rolling_counts(df, "org", "at", {"a": 60, "b": 700}).collect()}
    near = lambda o, t, s: sum(o == p and t - s <= u <= t for _, p, u in rows)
    assert got == {i: (o, near(o, t, 60), near(o, t, 700)) for i, o, t in rows if o is not None}


def test_error_classes(spark):
    edges = [("A", "UpstreamApiError"), ("B", "A"), ("C", "ContractError"), ("D", "C"), ("D", "B"), ("E", None), ("F", "G"), ("G", "F"), ("H", "UnusableDataError"), ("H", "ContractError"), ("ContractError", "Exception")]
    errors = [(c, m) for c in "ABCDEFH" for m in ("", "text")] + [("UnusableDataError", None), ("Elsewhere", "m")]
    found = documents.child_reasons(spark.createDataFrame(errors, "class string, message string"), spark.createDataFrame(edges, "class string, parent string")).collect()
    of = {r["class"]: r.reason for r in found}
    assert of == {"A": "upstream_api", "B": "upstream_api", "C": "contract_violation", "D": "upstream_api", "E": "unknown", "F": "unknown", "H": "unusable_data", "UnusableDataError": "unusable_data", "Elsewhere": "unknown"}
    assert {r.detail for r in found if r["class"] in ("A", "UnusableDataError")} == {"A()", "text", "UnusableDataError()"} and len(found) == len(errors)
