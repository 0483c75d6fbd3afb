"""No table of op5 is broadcast, small as its files may be: none passes through the driver."""

from ragspark.llm import components, neardup
from ragspark.session import materialise


def test_all_joins_merge(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df)

    monkeypatch.setattr(neardup, "materialise", noted)
    monkeypatch.setattr(components, "materialise", noted)
    vectors = [(i, [float(i % 7 + 1), float(i % 3), 1.0]) for i in range(40)]
    out = neardup.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 9
    assert not any("Broadcast" in p for p in plans)
