import math
import random


from peakview.plans import telemetry as TL


def _nearest_rank(values, f):
    s = sorted(values)
    return s[max(1, math.ceil(f * len(s))) - 1]


def test_latency_report_matches_nearest_rank(spark):
    rnd = random.Random(11)
    rows = [(g, rnd.choice([rnd.randrange(1, 50), rnd.randrange(50, 5000)])) for g in ("a", "b") for _ in range(997)]
    df = spark.createDataFrame(rows, "q string, ms long")
    got = {r["q"]: r for r in TL.latency_report(df, "ms", 100, ["q"]).collect()}
    for g in ("a", "b"):
        vals = [v for k, v in rows if k == g]
        r = got[g]
        assert (r["min"], r["max"], r["samples"]) == (min(vals), max(vals), len(vals))
        for f, col in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert r[col] == _nearest_rank(vals, f), (g, col)
        assert abs(r["share_within_target"] - sum(v <= 100 for v in vals) / len(vals)) < 1e-12


def test_drift_reports_moved_new_and_vanished_metrics(spark):
    cur = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "metric string, value double")
    base = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("d", 4.0)], "metric string, value double")
    got = {r["metric"]: (r["current"], r["baseline"]) for r in TL.drift(cur, base).collect()}
    assert got == {"b": (2.0, 2.5), "c": (3.0, None), "d": (None, 4.0)}
    assert TL.drift(cur, cur).count() == 0
