"""Decay, normalisation and blends of scores. Times are epoch seconds; `as_of` is always given."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0
#: Fixed values of the store's policy: a tier's weight and its days to live (None: for ever).
TIERS = {"procedural": (1.0, None), "semantic": (0.85, 180.0), "episodic": (0.70, 30.0)}
#: How fast a lane decays, times the base rate.
LANE_DECAY = {"identity": 0.0, "preference": 0.0, "procedural": 0.3, "rule": 0.5, "lesson": 0.5, "evidence": 0.7, "knowledge": 1.0, "emotion": 1.5, "general": 1.0}
HALF_LIFE_DAYS, FLOOR, IDLE_DAYS = 30.0, 0.2, 30.0
#: The weights of the five signals of recall.
SIGNALS = {"vector": 0.35, "text": 0.25, "time": 0.15, "reliability": 0.10, "heat": 0.15}


def choose(column: Column, table: dict, default) -> Column:
    """table[column], or default."""
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def tier_decay(tier: Column, age_s: Column) -> Column:
    """Half of what is left after each of the tier's days to live; 1 for a tier that lives for ever, and for a missing age."""
    days = choose(tier, {k: v[1] for k, v in TIERS.items() if v[1]}, None)
    age = F.greatest(F.coalesce(age_s, F.lit(0)), F.lit(0)) / DAY
    return F.coalesce(F.exp(-math.log(2) * age / days), F.lit(1.0))


def tier_deadline(tier: Column, since_s: Column) -> Column:
    """When a row of the tier ends to live, counted from since_s; null for a tier that lives for ever."""
    return since_s + choose(tier, {k: int(v[1] * DAY) for k, v in TIERS.items() if v[1]}, None)


def tier_score(tier: Column, age_s: Column, trust: Column) -> Column:
    """Weight of the tier, times decay, times trust; trust of 0 or null counts as one half."""
    weight = choose(tier, {k: v[0] for k, v in TIERS.items()}, TIERS["semantic"][0])
    return weight * tier_decay(tier, age_s) * F.when(F.coalesce(trust, F.lit(0.0)) == 0, F.lit(0.5)).otherwise(trust)


def heat_decay(salience: Column, lane: Column, idle_s: Column) -> Column:
    """Salience after idle seconds, by half-life and lane."""
    return salience * F.exp(-math.log(2) / HALF_LIFE_DAYS * choose(lane, LANE_DECAY, 1.0) * idle_s / DAY)


def squash(score: Column) -> Column:
    """0 for null or negative scores, the score itself up to 1, and a logistic of a tenth of it above, to 4 digits."""
    return F.when(score.isNull() | (score < 0), F.lit(0.0)).when(score > 1, F.round(1 / (1 + F.exp(-score / 10)), 4)).otherwise(score)


def recall_score(vector: Column, text: Column, age_days: Column, reliability: Column, access: Column) -> Column:
    """The five signals by their weights: an unknown age counts 0.5, reliability 0.5 if null, heat from accesses up to 100."""
    time = F.coalesce(F.exp(-0.05 * age_days), F.lit(0.5))
    heat = F.least(F.coalesce(access, F.lit(1)) / 100, F.lit(1.0))
    w = SIGNALS
    return w["vector"] * vector + w["text"] * text + w["time"] * time + w["reliability"] * F.coalesce(reliability, F.lit(0.5)) + w["heat"] * heat
