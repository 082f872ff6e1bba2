"""Every registered query against its DuckDB twin, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Some of each group; tests/oracle.py compares them all, at any scale.
CHOSEN = """
    ioc_01_refang ioc_02_ipv4 ioc_08_domain ioc_11_kind_dispatch_sl ioc_17_extract_sl h_05_normalize_heading
    h_23a_kind_dictionary_s1 h_30_typed_values flt_06_rule_chain flt_07_drop_reasons h_01_html_nodes h_03_node_text
    h_08_index_links_pp h_10a_publication_s1 h_19_30_entry_iocs_pp h_22_carry_hint_sl inc_01_previous_snapshot
    inc_02_new_entries inc_03_replay_snapshots inc_05_missing_entries src_02_validate_sources src_04_land_pages
    src_05_to_utf8 src_09_snapshot_json stx_07_reports stx_08_bundle_objects sur_06_render_rules run_06_health
""".split()


@pytest.fixture(scope="module")
def connection():
    return oracle.duckdb_connection(SF_DIR)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_duckdb(spark, connection, name):
    assert oracle.compare(spark, connection, name, QUERIES[name], SQL[name], SF_DIR) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
