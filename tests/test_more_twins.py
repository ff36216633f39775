"""Further queries against their SQL twins."""

import pytest

from larder.plans.registry import ORACLE_SQL, QUERIES

CHOSEN = ["q_access", "q_check", "q_destination", "q_permissions", "m_model_costs", "m_rejection_rate", "n_invites", "n_notices", "j_manifest", "t_words", "t_filenames", "t_formats", "v_site", "v_width", "d_row_cap", "d_layout", "d_decode", "t_modified", "i_keys", "i_result_keys"]


@pytest.mark.parametrize("name", CHOSEN)
def test_twin(same, name):
    same(QUERIES[name], ORACLE_SQL[name])
