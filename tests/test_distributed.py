"""The correctness gate once more on the paths of large tables: many sort partitions, hot keys split off.

At test size Spark would merge every sort into one partition, and no key is
hot. Here merging is off and every key that a layer's sketch names counts as hot.
"""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from churnkit.config import FIXTURE
from churnkit.operators import joins, ordering
from churnkit.plans.queries import QUERIES
from churnkit.plans.warehouse import Warehouse
from test_oracle import TABLES, _norm

SF = "/root/testdata/sf0.01"
#: Every query that uses ``ordering`` or ``skew_join``, itself or in its layers.
NAMES = [n for n in sorted(QUERIES) if n.split("_")[0] in ("st", "w", "ss") or n.startswith((
    "dq_00", "dq_03b", "dq_13", "dq_16", "dq_17", "eda_00", "eda_07", "eda_09", "eda_10", "eda_11", "eda_13", "eda_15",
    "eda_25", "eda_26", "eda_27", "v_17", "v_18"))]


@pytest.fixture(scope="module")
def forced(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    seen = {"splits": 0, "partitions": []}
    real_ordered, real_table, settings = ordering._ordered, joins.HotKeys.table, (joins.HOT_PER_PARTITION, joins.HOT_MIN_ROWS)

    def table(self, *args):
        seen["splits"] += 1
        return real_table(self, *args)

    def ordered(*args, **kwargs):
        out = real_ordered(*args, **kwargs)
        seen["partitions"].append(out.select("_p").distinct().count())
        return out

    for k, v in conf.items():
        spark.conf.set(k, v)
    joins.HotKeys.table, ordering._ordered = table, ordered
    joins.HOT_PER_PARTITION, joins.HOT_MIN_ROWS = 400, 0  # so every key the sketch names is hot
    yield Warehouse.from_fixtures(spark, SF, FIXTURE, buckets=4), seen
    joins.HotKeys.table, ordering._ordered = real_table, real_ordered
    joins.HOT_PER_PARTITION, joins.HOT_MIN_ROWS = settings
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_on_distributed_path(forced, con, name):
    wh, _ = forced
    df = QUERIES[name](wh)
    cur = con.execute(E.oracle_sql()[name])
    assert df.columns == [d[0] for d in cur.description]
    assert Counter(tuple(_norm(v) for v in r) for r in df.collect()) == Counter(tuple(_norm(v) for v in r) for r in cur.fetchall())


def test_the_distributed_paths_ran(forced):
    _, seen = forced
    assert seen["splits"] >= 10
    assert max(seen["partitions"]) > 1
