"""A sample of the named queries against their SQL, and the registry itself."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
SAMPLE = ["bars_1h", "bar_gaps", "asof_features", "rolling_quantiles", "ewm_mean_gaps", "bollinger_signals", "rule_metrics", "top_candidates",
          "uniqueness_weights", "stability_streak", "range_alerts", "text_scrub", "stream_bars"]

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")


def norm(pdf):
    pdf = pdf[sorted(pdf.columns)]
    cell = lambda v: None if v != v or v is None else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).replace(" 00:00:00", "")
    return Counter(tuple(cell(v) for v in row) for row in pdf.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(FOLDER)).toPandas()
    assert norm(got) == norm(want)


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100
    assert set(oracles) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_worker_functions_travel_by_value():
    from pyspark import cloudpickle

    from barloom.plans.metalabel import _newton_step

    # an import by name would fail on executors that have no copy of the package
    code = cloudpickle.dumps(_newton_step)
    assert b"linalg" in code and len(code) > 500
