"""Predicates and derived columns of deals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard.functions.text import literal_map

# Closing probability in percent by sales stage.
STAGE_PROBABILITIES = {
    "A. Lead Generated": 10.0,
    "Lead": 10.0,
    "B. Sales Qualified Leads": 20.0,
    "C. Demo Done": 30.0,
    "D. Feasibility": 40.0,
    "I. Poc": 40.0,
    "E. Proposal/Commercials Sent": 60.0,
    "Proposal": 60.0,
    "F. Negotiations": 80.0,
    "Negotiation": 80.0,
    "H. Work Order Received": 95.0,
    "J. Invoice Sent": 95.0,
    "G. Project Won": 100.0,
    "Won": 100.0,
    "Project Completed": 100.0,
    "K. Amount Accrued": 100.0,
    "L. Project Lost": 0.0,
    "Lost": 0.0,
    "M. Projects On Hold": 0.0,
    "N. Not Relevant At The Moment": 0.0,
    "O. Not Relevant At All": 0.0,
}
# The probability of an unknown stage, and the buckets.
DEFAULT_PROBABILITY = 20.0
BUCKETS = ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")


def is_won(stage: Column) -> Column:
    return stage.eqNullSafe("Won")


def is_lost(stage: Column) -> Column:
    return stage.eqNullSafe("Lost")


def is_open(stage: Column) -> Column:
    """Neither won nor lost; a deal without a stage is open."""
    return ~F.coalesce(stage.isin("Won", "Lost"), F.lit(False))


def stage_probability(stage: Column, default: float = DEFAULT_PROBABILITY) -> Column:
    """Percent of a stage. The table is a 21-entry literal, so no join is planned."""
    return F.coalesce(F.try_element_at(literal_map(STAGE_PROBABILITIES), stage), F.lit(default))


def effective_probability(
    probability: Column, stage: Column, default: float = DEFAULT_PROBABILITY, zero_falls_through: bool = False
) -> Column:
    """The stated probability, or that of the stage where none (or 0) is stated.

    With ``zero_falls_through`` a stage worth 0 percent counts as unknown, the browser's rule.
    """
    of_stage = stage_probability(stage, default)
    if zero_falls_through:
        of_stage = F.when(of_stage == 0, F.lit(default)).otherwise(of_stage)
    return F.when(probability.isNull() | (probability == 0), of_stage).otherwise(probability)


def weighted_value(value: Column, probability: Column, stage: Column) -> Column:
    """Value times probability; a probability up to 1 is a share, above it a percentage."""
    p = effective_probability(probability, stage)
    return F.when((p > 0) & (p <= 1), value * p).otherwise(value * (p / 100))


def weighted_value_raw(value: Column, probability: Column) -> Column:
    """Like ``weighted_value`` without the stage default: probability 0 gives 0."""
    return F.when(probability <= 1, value * probability).otherwise(value * (probability / 100))


def weighted_value_interactive(value: Column, probability: Column, stage: Column) -> Column:
    """The browser's variant: stages worth 0 percent weigh as unknown ones."""
    p = effective_probability(probability, stage, zero_falls_through=True)
    return F.when(p <= 1, value * p).otherwise(value * (p / 100))


def probability_pct(probability: Column, stage: Column) -> Column:
    """Probability as a percentage, from the stage where none is stated."""
    return (
        F.when(probability.isNull() | (probability == 0), stage_probability(stage))
        .when(probability > 1, probability)
        .otherwise(probability * 100)
    )


def probability_pct_interactive(probability: Column, stage: Column) -> Column:
    """The browser's variant: unknown stages count 0."""
    p = effective_probability(probability, stage, default=0.0)
    return F.when(p <= 1, p * 100).otherwise(p)


def probability_bucket(pct: Column) -> Column:
    chain = F
    for upper, label in zip((20, 40, 60, 80), BUCKETS):
        chain = chain.when(pct <= upper, F.lit(label))
    return chain.otherwise(F.lit(BUCKETS[-1]))
