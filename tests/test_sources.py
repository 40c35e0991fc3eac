"""Sources that fail part of the way, and a live table behind a server."""

import pytest

from posterboard.sources import base
from posterboard.sources.base import Source, live_table, pieces, read_all


def test_rows_before_a_failure_stay(spark):
    def iterate(part):
        for i in range(part["n"]):
            if i == part.get("fails_at"):
                raise RuntimeError("the server went away")
            yield {"id": i, "title": f"row {i}"}

    spark.dataSource.register(pieces("broken", "id long, title string", [{"n": 5000, "fails_at": 999}], iterate))
    spark.dataSource.register(pieces("mixed", "id long, title string", [{"n": 10}, {"n": 10, "fails_at": 4}, {"n": 3}], iterate))
    spark.dataSource.register(pieces("dead", "id long, title string", [{"n": 10, "fails_at": 0}], iterate))
    sources = [Source(name, lambda s, name=name: s.read.format(name).load()) for name in ("broken", "mixed", "dead")] + [Source("fine", lambda s: s.range(3).selectExpr("id", "'x' AS title"))]
    rows, outcomes = read_all(spark, sources)
    assert rows["broken"].count() == 999 and rows["mixed"].count() == 17 and rows["fine"].count() == 3 and "dead" not in rows
    assert [(o.name, o.state) for o in outcomes] == [("broken", "partial"), ("mixed", "partial"), ("dead", "failed"), ("fine", "read")]
    assert "the server went away" in outcomes[0].reason and base.FAILURE not in rows["broken"].columns


@pytest.fixture
def pushed(spark):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    yield
    spark.conf.set(key, before)


def test_live_table(spark, pushed):
    def fetch(filters, order, limit):
        table = [{"id": i, "title": f"t{i % 3}", "report_count": i % 5} for i in range(100)] + ["no row"]
        table = [r for r in table if not isinstance(r, dict) or all({"eq": r[c] == v, "gte": r[c] >= v, "lt": r[c] < v}[op] for c, op, v in filters)]
        if order == "id.desc":
            table = table[::-1]
        # what the server was asked for comes back in a row of its own
        return [{"id": len(filters), "title": ",".join(f"{c}.{op}" for c, op, _ in filters) or "all", "report_count": 3}, *table][:limit]

    spark.dataSource.register(live_table("live", "id long, title string, report_count long", fetch))
    df = spark.read.format("live").option("order", "id.desc").option("limit", "50").load()
    assert df.count() == 49  # one is no row
    few = df.where("report_count >= 3 AND id < 90 AND title LIKE 't%'")
    got = few.collect()
    assert all(r.report_count >= 3 and r.id < 90 for r in got) and [r.id for r in got][:2] == [89, 88]
    asked = df.where("report_count >= 3 AND id < 90").where("title LIKE 'report%'").collect()
    assert asked and "report_count.gte" in asked[0].title and "id.lt" in asked[0].title


def test_live_table_without_a_server(spark, pushed):
    def fetch(filters, order, limit):
        raise OSError("unreachable")

    spark.dataSource.register(live_table("gone", "id long", fetch))
    spark.dataSource.register(live_table("html", "id long", lambda filters, order, limit: "<html>"))
    assert spark.read.format("gone").load().count() == 0 and spark.read.format("html").load().count() == 0
