"""How often queries read the given tables, and what they move: plans over the smallest tables."""

import os
import re

import pytest

from voxtab.operators import roi
from voxtab.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


def plan(spark, name):
    return registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def scans(text, table):
    return len(re.findall(rf"FileScan parquet .*{table}\.parquet", text))


def test_parse_gsps_reads_the_elements_once(spark):
    text = plan(spark, "parse_gsps")
    assert scans(text, "lineitem") == 3 and "Join" not in text  # drawings, layers, states


def test_gsps_references_are_found_in_one_pass_without_a_sort_of_all_elements(spark):
    text = plan(spark, "gsps_references")
    assert scans(text, "lineitem") == 3 and "Join" not in text and "SortAggregate(key=[file" not in text.split("Exchange")[-1]


def test_references_of_states(spark):
    rows = [("a", "00700001/0/00700009/0/00700023", "POLYLINE"), ("a", "00700001/1/00081140/2/00081155", "5.2"), ("a", "00700001/1/00081140/10/00081155", "5.10"), ("a", "00700001/1/00081140/1/00081155", " "),
            ("a", "00081115/1/00081140/0/00081155", "7.1"), ("a", "00081115/0/00081140/3/00081155", " 7.0 "), ("b", "00700001/0/00700002", "L"), ("c", "00081115/0/00081140/0/00081155", "9")]
    states = spark.createDataFrame(rows, "file string, tag_path string, value string")
    assert {tuple(r) for r in roi.gsps_references(state_tags=states).collect()} == {("a", 0, "7.0"), ("a", 1, "5.2"), ("b", 0, None)}


def test_validation_moves_no_parts(spark):
    text = plan(spark, "validate_tag_values")
    assert "Aggregate" not in text and "explode(split" not in text


def test_edits_look_at_their_series_only(spark):
    text = plan(spark, "edit_tag")
    assert scans(text, "lineitem") == 2 and len(re.findall(r"Filter .*1\.2\.4\..* = 1\.2\.4\.3", text)) == 2


def test_boxes_are_not_written_out_at_the_tables(spark):
    text = registry.QUERIES["drawing_metrics"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in text.splitlines() if "Filter" in line) < 15000


def test_series_of_the_registry_are_grouped_once(spark):
    assert scans(plan(spark, "upsert_series_registry"), "lineitem") == 2


@pytest.mark.parametrize("name", ["remap_uids", "deidentify_tags"])
def test_elements_are_not_moved_by_uid(spark, name):
    text = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Join LeftOuter", text)) == len(re.findall(r"Join LeftOuter, .*rightHint=\(strategy=broadcast\)", text)) > 0
