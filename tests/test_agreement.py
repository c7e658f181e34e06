"""Registered queries against their SQL on the smallest tables. All of them run with VOUCHLINE_ALL=1."""

import os

import pytest

from tests.agreement import compare, duck
from vouchline.plans import catalog

SF = "/root/testdata/sf0.001"
QUICK = ["flagship", "e6_heuristic", "e7_rules", "e9_recurring", "e13_precedence", "c1_content_hash", "c9_usage_summary", "m3_token_suggestions", "m7_suggestions",
         "q9_bulk_update", "q15_isolation", "x4_rollup", "x5_voucher_entries", "snk1_csv", "snk2_json", "snk3_voucher_xml", "p11_transactions", "p12_text_lines",
         "o2_cells", "o4_block_cells", "k2_compare", "k5_running_rate", "r1_mask", "r5_scrub_record", "t1_window_rates_stream", "t2_held_alerts", "v5_warnings", "v8_stitched"]
NAMES = list(catalog.QUERIES) if os.environ.get("VOUCHLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_agreement(spark, con, name):
    note, _, good = compare(spark, con, SF, name, catalog.QUERIES[name], catalog.SQL.get(name))
    assert good, note
