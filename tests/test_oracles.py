"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from oracle_check import compare, connect

from talkloom.plans.registry import registered

SF = "/root/testdata/sf0.001"
#: Queries without SQL, with the test that holds their operator against another way.
TESTED_OTHERWISE = {
    "unit_payloads": "tests/test_operators.py::test_unit_payloads_round_trip",
    "chunk_contamination": "tests/test_operators.py::test_chunk_contamination_brute_force",
    "claim_violations": "tests/test_operators.py::test_claim_violations_find_each_fault_once",
    "note_lines": "tests/test_operators.py::test_note_lines_in_order",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(registered()))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name)
    assert not result.startswith(("FAIL", "ERROR")) and "EMPTY" not in result, result
    assert result.startswith("ok") or name in TESTED_OTHERWISE, result
