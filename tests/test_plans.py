"""The plans that matter at scale: pruned scans, pushed filters, no cross joins."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scan_reads_only_what_it_needs(spark):
    p = plan(entry.queries()["latest_run_per_job"](spark, SF))
    schema = next(line for line in p.splitlines() if "ReadSchema" in line)
    assert "document_hash" not in schema and "run_id" in schema


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(document_hash), IsNotNull(pipeline_version)]" in plan(entry.queries()["version_numbering"](spark, SF))
    assert "EqualTo(field_name,grand_total)" in plan(entry.queries()["currency_parse"](spark, SF))


@pytest.mark.parametrize("name", ["audit_trail", "engine_agreement", "nearest_label", "inverted_index_candidates", "recalculate_totals", "template_match", "box_iou"])
def test_no_cross_join(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
