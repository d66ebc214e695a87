from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("c, agrees, want", [(0.6, True, 0.636), (0.6, False, 0.545), (0.9, True, 0.909), (0.9, False, 0.818), (0.3, True, 0.364), (1.0, True, 1.0)])
def test_bayes(spark, c, agrees, want):
    assert one(spark, scoring.bayesian_update(F.lit(c), agrees)) == pytest.approx(want, abs=1e-3)


def test_bayes_converges(spark):
    up = scoring.bayesian_fold(F.lit(0.3), F.array_repeat(F.lit(True), 50))
    down = scoring.bayesian_fold(F.lit(0.9), F.array_repeat(F.lit(False), 50))
    assert one(spark, up) > 0.95 and one(spark, down) < 0.05


@pytest.mark.parametrize("c, days, half, want", [(0.9, 0, 90, 0.9), (0.6, 90, 90, 0.3), (0.8, 180, 90, 0.2), (0.3, 900, 90, 0.05), (0.7, -5, 90, 0.7), (1.0, 30, 30, 0.5)])
def test_decay(spark, c, days, half, want):
    assert one(spark, scoring.temporal_decay(F.lit(c), F.lit(float(days)), half)) == pytest.approx(want, abs=1e-3)


def test_effective_confidence_takes_the_reinforcement(spark):
    rows = [(0.6, datetime(2023, 12, 3), datetime(2023, 1, 1)), (0.6, None, datetime(2023, 12, 3)), (0.6, None, None)]
    df = spark.createDataFrame(rows, "confidence double, last_reinforced timestamp_ntz, valid_from timestamp_ntz")
    got = [x[0] for x in df.select(scoring.edge_confidence("2024-03-02 00:00:00")).collect()]
    assert got == pytest.approx([0.3, 0.3, 0.6], abs=1e-3)


def test_hours_are_truncated(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 1),), (datetime(2024, 1, 3),)], "t timestamp_ntz")
    assert [x[0] for x in df.select(scoring.whole_hours_as_days(F.col("t"), "2024-01-02 00:00:00")).collect()] == [23 / 24, -1.0]
    assert [x[0] for x in df.select(scoring.whole_days(F.col("t"), "2024-01-02 00:00:00")).collect()] == [0, -1]


@pytest.mark.parametrize("outcome, used, want", [("success", True, 0.55), ("partial", True, 0.5), ("failed", True, 0.45), ("success", False, 0.49)])
def test_utility_step(spark, outcome, used, want):
    assert one(spark, scoring.utility_step(F.lit(0.5), F.lit(outcome), F.lit(used))) == pytest.approx(want, abs=1e-6)


def test_score_cosine_and_priors(spark):
    assert one(spark, scoring.blended_score(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(1.0)
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, scoring.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.70710678)
    assert one(spark, scoring.cosine(v(0, 0), v(1, 1))) is None and one(spark, scoring.cosine(v(1), v(1, 1))) is None
    assert one(spark, scoring.prior(F.lit("explicit"))) == pytest.approx(0.9, abs=1e-7) and one(spark, scoring.prior(F.lit(None))) == pytest.approx(0.6, abs=1e-6)
    assert one(spark, scoring.path_confidence(v(0.9, 0.8, 0.7))) == pytest.approx(0.504) and one(spark, scoring.path_confidence(F.array().cast("array<double>"))) == 1.0
