"""Queries over the whole of their tables: each SQL twin is held without the filter on ids that it has."""

import pytest
from test_entry import database, plain, sf_dir  # noqa: F401

from govlens.queries import ORACLES, QUERIES

FILTERS = {" WHERE (source * 7 + target * 3) % 11 = 0": ["graph_density", "layer_fanout_violations", "graph_degrees", "graph_cycles", "reachable_nodes", "edge_ego_network", "component_layer_labels"], " AND project % 4 = 0": ["new_violations"]}


@pytest.mark.parametrize(("part", "name"), [(part, name) for part, names in FILTERS.items() for name in names])
def test_no_row_is_left_out_by_its_id(spark, sf_dir, database, part, name):  # noqa: F811
    cursor = database.execute(ORACLES[name].replace(part, ""))
    columns = [d[0] for d in cursor.description]
    expected = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in QUERIES[name](spark, sf_dir).collect()) == expected
