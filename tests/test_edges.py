import importlib

import pytest
from edge_tables import empty, hollow

import __spark_entry__ as entry

CHOSEN = ["p3_found", "p4_found", "p4_trackers", "p5_found", "p5_times", "text_features", "content_entropy", "html_domains", "has_symbol_in", "match_meta_in", "match_relation_meta", "has_sibling",
          "count_descendants", "neighbours_near", "scenario_max_neighbors", "selector_symbols", "events_window"]


@pytest.mark.parametrize("make", [empty, hollow])
def test_empty_and_hollow_tables(spark, tmp_path, make):
    d = make(spark, tmp_path / "t")
    core = {k: f for m in entry.CORE for k, f in importlib.import_module(m).QUERIES.items()}
    for name in CHOSEN:
        n = len(core[name](spark, d).collect())
        assert make is hollow or n == 0, name
