"""Closures broadcast a side only where a count says that it is small."""

from __future__ import annotations

from lattica.operators import closure


def test_no_broadcast_beyond_the_count(spark, monkeypatch):
    arcs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n6", "n4")], "src string, dst string")
    start = arcs.selectExpr("src AS origin", "dst AS id")
    want = sorted(map(tuple, closure.closure(start, arcs).collect()))
    plans, write = [], closure.materialise
    monkeypatch.setattr(closure, "materialise", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    monkeypatch.setattr(closure, "SMALL_INDEX", 0)
    monkeypatch.setattr(closure, "SMALL_SIDE", 0)
    assert sorted(map(tuple, closure.closure(start, arcs).collect())) == want
    assert not any("LeftAnti" in p and "BroadcastHashJoin" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
