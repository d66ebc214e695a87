"""Similarity, hotness, confidence and utility as column expressions.

Everything that depends on the time takes `as_of`, so results are reproducible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 90.0
FLOOR = 0.05
LEAST_CONFIDENCE = 0.1
PSEUDOCOUNT = 10.0
HOTNESS_HALF_LIFE_DAYS = 7.0
# Fixed values.
PRIORS = {"authoritative": 1.0, "explicit": 0.9, "inferred": 0.6, "speculative": 0.3}
REWARDS = {"success": 1.0, "partial": 0.5, "failed": 0.0}
USED_RATE, UNUSED_RATE, UNUSED_REWARD = 0.1, 0.05, 0.3


@dataclass(frozen=True)
class Weights:
    similarity: float = 0.45
    hotness: float = 0.30
    utility: float = 0.25


def literal_time(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, all zero or of another width."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def whole_hours_as_days(since: Column, as_of: str | Column) -> Column:
    """Elapsed whole hours (truncated) / 24."""
    micros = F.unix_micros(literal_time(as_of).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    hours = F.when(micros >= 0, F.floor(micros / 3_600_000_000)).otherwise(F.ceil(micros / 3_600_000_000))
    return hours.cast("double") / 24.0


def whole_days(since: Column, as_of: str | Column) -> Column:
    micros = F.unix_micros(literal_time(as_of).cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.when(micros >= 0, F.floor(micros / 86_400_000_000)).otherwise(F.ceil(micros / 86_400_000_000))


def hotness(access_count: Column, updated_at: Column, as_of: str | Column) -> Column:
    """(1 + n) / (2 + n), halved every 7 days since the last update (30 if unknown)."""
    n = access_count.cast("double")
    days = F.coalesce(whole_hours_as_days(updated_at, as_of), F.lit(30.0))
    return (1.0 + n) / (2.0 + n) * F.pow(F.lit(0.5), days / HOTNESS_HALF_LIFE_DAYS)


def blended_score(similarity: Column, hot: Column, utility: Column, w: Weights = Weights()) -> Column:
    return w.similarity * similarity + w.hotness * hot + w.utility * utility


def temporal_decay(confidence: Column, days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Halved every half-life, never under the floor; not decayed before day 0."""
    return F.when(days <= 0, confidence).otherwise(F.greatest(confidence * F.pow(F.lit(0.5), days / half_life), F.lit(FLOOR)))


def effective_confidence(confidence: Column, last_reinforced: Column, valid_from: Column, as_of: str | Column) -> Column:
    """Confidence as it stands now: decayed from the last reinforcement, else from
    when the edge became valid; undecayed if neither is known."""
    days = whole_hours_as_days(F.coalesce(last_reinforced, valid_from), as_of)
    return F.when(days.isNull(), confidence).otherwise(temporal_decay(confidence, days))


def edge_confidence(as_of: str | Column) -> Column:
    return effective_confidence(F.col("confidence"), F.col("last_reinforced"), F.col("valid_from"), as_of)


def bayesian_update(confidence: Column, corroborates: Column | bool) -> Column:
    a = confidence * PSEUDOCOUNT
    agrees = F.lit(corroborates) if isinstance(corroborates, bool) else corroborates
    return F.when(agrees, (a + 1.0) / (PSEUDOCOUNT + 1.0)).otherwise(a / (PSEUDOCOUNT + 1.0))


def bayesian_fold(confidence: Column, observations: Column) -> Column:
    """Confidence after an array of booleans, in order."""
    return F.aggregate(observations, confidence.cast("double"), lambda c, o: bayesian_update(c, o))


def prior(kind: Column) -> Column:
    """Prior of a stated certainty; inferred if unknown.  Stored in single precision."""
    known = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in PRIORS.items()), F.lit(PRIORS["inferred"]))
    return known.cast("float").cast("double")


def reward(outcome: Column) -> Column:
    return F.coalesce(*(F.when(outcome == k, F.lit(v)) for k, v in REWARDS.items()))


def utility_step(utility: Column, outcome: Column, used: Column) -> Column:
    """One step of the moving average: used entities towards the outcome's reward,
    unused ones slowly towards a low one."""
    rate = F.when(used, F.lit(USED_RATE)).otherwise(F.lit(UNUSED_RATE))
    goal = F.when(used, reward(outcome)).otherwise(F.lit(UNUSED_REWARD))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1.0 - rate) * utility + rate * goal))


def path_confidence(edges: Column) -> Column:
    """Product of the confidences along a path; 1 for the empty path."""
    return F.aggregate(edges, F.lit(1.0), lambda a, x: a * x)
