"""What is broadcast has been counted or measured: small files alone are no reason."""

from turnlake.llm import common, links
from turnlake.llm.common import small, tidy, written

SETTINGS = (common.CLEANUP, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def settings(spark):
    return [spark.conf.get(key, None) for key in SETTINGS]


def test_small_files_of_many_rows_are_not_broadcast(spark):
    many, rows = written(spark.range(300_000)), spark.range(5_000_000)
    assert "BroadcastHashJoin" in plan(rows.join(many, "id"))  # Spark's own choice, by the size of the files
    before = settings(spark)
    with tidy(spark), tidy(spark):
        assert "BroadcastHashJoin" not in plan(rows.join(many, "id")) and "BroadcastHashJoin" in plan(rows.join(small(many, 300_000), "id"))
    assert settings(spark) == before
    for kind in ("inner", "left", "left_anti", "left_semi"):  # results that are computed after the step
        assert "BroadcastHashJoin" not in plan(rows.join(small(many).select("id"), "id", kind))
    assert rows.join(small(many), "id").count() == 300_000


def test_links_meet_without_unmeasured_broadcasts(spark, monkeypatch):
    plans = []
    ends = written(spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(1, 9)], "a long, b long"))
    monkeypatch.setattr(links, "written", lambda df, f=links.written: plans.append(plan(df)) or f(df))
    with tidy(spark):
        found = links.components(ends)
    assert {tuple(r) for r in found.collect()} == {(i, {8: 0, 9: 0}.get(i, i - i % 2)) for i in range(40)}
    assert any("Join" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
