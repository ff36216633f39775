"""Queries against their SQL twins on the smallest tables."""

import pytest

from larder.plans.registry import ORACLE_SQL, QUERIES

CHOSEN = [
    "v_date", "v_order", "v_output_line", "f_findings", "f_rejection", "d_tokenize", "f_unreadable", "v_verdict", "a_claim", "a_reap", "a_verdict", "a_errors", "a_apply", "n_outbox",
    "i_checks", "i_unique", "i_foreign", "i_retry", "i_objects", "q_access", "q_invite_state", "q_detail", "q_rate_breaks", "q_screen", "m_costs", "m_durations", "m_top", "j_run",
    "j_result", "j_progress", "j_failure", "q_closure", "q_forget", "q_soft_delete", "q_sole_admins", "i_admins", "v_product", "t_words", "t_uuid", "v_metadata", "w_sessions", "w_supervise",
]


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", CHOSEN)
def test_twin(same, name):
    same(QUERIES[name], ORACLE_SQL[name])
