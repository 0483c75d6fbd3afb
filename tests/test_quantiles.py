import math
import random

import pytest

from ragspark.operators import ranking

INF = math.inf
CASES = {
    "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0, 1e-300, 1e300] * 3,
    "infinite": [INF] * 6 + [-INF] * 3 + [1.0, 2.0, 3.0],
    "only infinite": [INF, -INF, INF],
    "geometric": [10.0 ** i for i in range(-12, 12, 3)],
    "hot": [7.0] * 500 + [float(i) for i in range(40)],
    "one": [3.5],
}


@pytest.mark.parametrize("few", [100_000, 0])
def test_ranks_of_awkward_groups(spark, few):
    random.seed(3)
    rows = [(k, x) for k, xs in CASES.items() for x in random.sample(xs, len(xs))] + [(None, 1.0), (None, 9.0), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranking.latency_stats(df, ["g"], "v", 256, few).collect()}
    assert set(got) == {*CASES, None}
    for g, xs in [*CASES.items(), (None, [1.0, 9.0])]:
        xs = sorted(xs)
        n = len(xs)
        r = got[g]
        assert (r.n, r.p95_ms, r.min_ms, r.max_ms) == (n, xs[min(int(n * 0.95), n - 1)], xs[0], xs[-1]), g
        want = (xs[(n - 1) // 2] + xs[n // 2]) / 2
        assert r.median_ms == want or math.isnan(want) and math.isnan(r.median_ms), g


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(math.nan,)] * 2, "v double")
    for few in (100_000, 0):
        r = ranking.latency_stats(df, [], "v", 4, few).first()
        assert r.n == 11 and r.median_ms == 5.0 and math.isnan(r.p95_ms) and r.min_ms == 0.0
    assert ranking.latency_stats(df.where("v < -1"), [], "v").isEmpty()
