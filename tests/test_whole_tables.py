"""Queries over whole tables beside those that their SQL binds to a part."""

from collections import defaultdict

import pytest
from oracle import rows, sql

from grove import catalog
from grove.plans import derive

DATA = "/root/testdata/sf0.01"


def test_averages_of_the_whole_trace_go_over_blocks(spark):
    series = defaultdict(list)
    for r in derive.trace(spark, DATA).orderBy("row_idx").collect():
        series[r.op].append((r.row_idx, r.duration))
    assert max(map(len, series.values())) > 2 * 432  # rows of a block at momentum 0.5
    want = {}
    for op, values in series.items():
        hidden = 0.0
        for n, (at, x) in enumerate(values, 1):
            hidden = 0.5 * hidden + 0.5 * x
            want[op, at] = hidden / (1 - 0.5**n)
    found = {(r.op, r.row_idx): r.ema for r in catalog.queries()["ema_evolution"](spark, DATA).collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], abs=2e-6) for k in want)


@pytest.mark.parametrize("name", ["tree_fold_uniq_all", "gc_live_all"])
def test_whole_tables(spark, name):
    assert rows(catalog.queries()[name](spark, DATA)) == sql(catalog.oracle_sql()[name], DATA)
