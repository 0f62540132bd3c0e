"""Registered queries: result columns, and SQL where there is one."""

import pytest

from papyrine.llm import queries
from tests.oracle import expected, rows

COLUMNS = {
    "p1_found": ["vec_a", "vec_b"], "p2_found": ["kind", "name_a", "name_b"], "p4_found": ["unit_kind", "unit_id", "end_pos"],
    "p5_found": ["kind", "key_a", "key_b"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, smallest, name):
    df = queries.queries()[name](spark, smallest)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    got = df.toPandas()
    if name in queries.oracle_sql():
        assert rows(got) == rows(expected(smallest, queries.oracle_sql()[name]))
    assert not got.duplicated().any()
