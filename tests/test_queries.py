"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")

from loomgrid.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    v = float(v)
    return None if math.isnan(v) else round(v, 5) + 0.0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    r = duck.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    order = sorted(df.columns)
    ours = sorted((tuple(plain(x[c]) for c in order) for x in rows), key=str)
    theirs = sorted((tuple(plain(x[r.columns.index(c)]) for c in order) for x in r.fetchall()), key=str)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-4) for x, y in zip(a, b, strict=True)), (a, b)


#: Charts with several cuts of equal sums, where the order of additions decides: c(lick), v(iew), p(urchase), s(ignup), e(rror).
EQUAL_CUTS = (
    "vceeeseeepecepsvsscvcvcpcppsesssvpsscvcccvspcvvvcpssvepcppvcepsvcecc", "ecvcvsvpppvsevsscepsvvepevsppcsvpccsssveepcevsvsseeescvveeevpppseespc",
    "pvepvcppevvvpeesepsvepspsvscpevcppcpsecscpepvpcsppessvcvvspsvpcsvvseess", "vcpscvpscecpcpesppcepccspspcececcvccecsspvsssspepevsscvsvppssepcpvcevcvcspv",
)


def test_cuts_of_equal_sums(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    kinds = {"c": "click", "v": "view", "p": "purchase", "s": "signup", "e": "error"}
    rows = [(100 * u + k, u, k, kinds[x]) for u, chart in enumerate(EQUAL_CUTS) for k, x in enumerate(chart)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, k int, event_type string").selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(1704067200 + k) AS ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    r = c.sql(registry.oracle_sql()["segmentation_reports"])
    ours = registry.queries()["segmentation_reports"](spark, str(tmp_path)).select(*r.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(r.fetchall())


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
