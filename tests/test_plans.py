"""Plan-shape guards: no cartesian products, no sort-based aggregation on
text, and pruned scans for the headline queries."""

import contextlib
import io

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, SF).explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["k5_bias_table", "k8_final_metric", "j2_collapse_duplicates",
                                  "f4_vocabulary", "f8_encode", "i6_cooccurrence", "i1_describe"])
def test_no_cartesian_or_sort_aggregate(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "SortAggregate" not in p


def test_scan_is_pruned(spark):
    p = plan(spark, "i7_hist_lineitem")
    assert "ReadSchema: struct<l_extendedprice:double>" in p
    p = plan(spark, "b5_to_bool")
    schemas = [line for line in p.splitlines() if "ReadSchema:" in line]
    assert schemas and all("text:" not in line for line in schemas)
