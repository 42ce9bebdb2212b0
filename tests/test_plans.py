"""Plan properties of every registered query (the scale rules, checked on
the physical plans): no Cartesian product or nested-loop join, no Python
UDF, and scans that read only the columns the query uses.  Both the returned
frame's plan and the plans of all jobs that ran while it was made (statistics passes, model fits,
evaluations) are checked; the latter come from Spark's event log."""

import contextlib
import io
import json
import re

import pytest

from riskspark.plans.registry import QUERIES
from tests.conftest import SF0001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "FlatMapGroupsInArrow")
# Full width of each source table: a scan reading all of them for a query
# that needs fewer would show up here.
TABLE_WIDTH = {"lineitem": 11, "events": 6, "orders": 6, "embeddings": 3, "labels": 3}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def ran(spark, event_log):
    """(name -> formatted plan of the returned frame, nodes of all plans that ran meanwhile)."""
    log = next(event_log.iterdir())
    before = log.stat().st_size
    plans = {name: _plan(fn(spark, SF0001)) for name, fn in QUERIES.items()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    nodes: set[str] = set()

    def walk(node):
        nodes.add(node["nodeName"].split(" (")[0])
        for child in node["children"]:
            walk(child)

    with log.open() as f:
        f.seek(before)
        for line in f:
            if '"sparkPlanInfo"' in line:
                walk(json.loads(line)["sparkPlanInfo"])
    return plans, nodes


@pytest.fixture(scope="module")
def plans(ran):
    return ran[0]


def test_jobs_inside_the_queries(ran):
    nodes = ran[1]
    assert {"HashAggregate", "Exchange", "InMemoryTableScan"} <= nodes        # the fits' jobs were seen
    assert not nodes & set(FORBIDDEN)


def test_no_cross_products_or_python(plans):
    for name, text in plans.items():
        for op in FORBIDDEN:
            assert op not in text, f"{name}: {op} in plan"


SCAN = re.compile(r"file:[^\]\n]*/(\w+)\.parquet\]\n(?:(?!ReadSchema)[^\n]*\n){0,4}ReadSchema: struct<([^\n]*)>")


def test_scans_are_pruned(plans):
    seen = 0
    for name, text in plans.items():
        for table, schema in SCAN.findall(text):
            seen += 1
            width = len(re.findall(r"(?:^|,)\w+:", schema))
            if table in TABLE_WIDTH:
                assert width < TABLE_WIDTH[table], f"{name}: reads all {width} columns of {table}"
    assert seen >= 15        # the lazy queries' scans were all found
