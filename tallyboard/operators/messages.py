"""Routing of messages to reports, and the recent turns of conversations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.functions.text import strip

# Messages too vague to route.
AMBIGUOUS = ("status", "how are we doing", "performance", "update", "how's things", "report")

# Keywords of each route; the first route with a keyword in the message wins.
ROUTES = (
    ("leadership_summary", ("leadership", "executive summary", "weekly update")),
    ("pipeline_vs_work_orders", ("compare", "versus", "vs")),
    ("data_quality", ("data quality", "governance", "completeness", "missing", "error")),
    ("owner_analysis", ("owner", "assignee", "who owns", "workload")),
    ("stage_breakdown", ("stage", "breakdown", "funnel")),
    ("top_deals", ("top", "highest value", "biggest", "largest")),
    ("revenue_forecast", ("forecast", "expected close", "months")),
    ("delayed_work_orders", ("delayed", "late", "overdue", "bottleneck")),
    ("work_order_summary", ("work order", "project")),
    ("open_opportunities", ("opportunity", "opportunities", "deal count")),
    ("pipeline_summary", ("pipeline", "sales", "commercial")),
)
DEFAULT_ROUTE = "general_business_health"

# Fixed value: what an ambiguous message is answered with.
QUESTION = (
    "Could you clarify if you want a Pipeline Summary, open opportunities count, "
    "delayed work orders details, or a general Leadership Summary?"
)

# Turns kept per conversation, shown to the router, shown to the answerer.
KEPT_TURNS = 20
ROUTING_TURNS = 3
ANSWER_TURNS = 5


def is_ambiguous(text: Column) -> Column:
    return strip(F.lower(text)).isin(*AMBIGUOUS)


def route_of(lowered: Column) -> Column:
    """Route of a lower-case message by plain substring search; ``stop`` does contain ``top``."""
    chain = F
    for route, keywords in ROUTES:
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(lowered, F.lit(keyword))
        chain = chain.when(hit, F.lit(route))
    return chain.otherwise(F.lit(DEFAULT_ROUTE))


def route_messages(messages: DataFrame) -> DataFrame:
    """Each message with its route; ambiguous ones get the default, and the question that is asked back."""
    lowered = messages.select("conversation_id", "turn", "text", F.lower("text").alias("lowered"))
    vague = is_ambiguous(F.col("lowered"))
    return lowered.select(
        "conversation_id",
        "turn",
        "text",
        vague.alias("is_ambiguous"),
        F.when(vague, F.lit(QUESTION)).alias("question"),
        F.when(vague, F.lit(DEFAULT_ROUTE)).otherwise(route_of(F.col("lowered"))).alias("route"),
    )


def route_volume(messages: DataFrame) -> DataFrame:
    return route_messages(messages).groupBy("route").count()


# Spark's default for spark.sql.optimizer.windowGroupLimitThreshold.
MOST_TURNS = 1000


def _latest(turns: DataFrame, n: int, *keys: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("turn").desc()))
    return turns.withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth")


def salts_for(longest: int, n: int) -> int:
    """Parts of the longest conversation for which the largest part and what all parts leave are about as long."""
    return max(1, math.isqrt(max(0, longest - 1) // n) + 1)


def recent_turns(turns: DataFrame, n: int = KEPT_TURNS, salts: int | None = None) -> DataFrame:
    """The last ``n`` turns of each conversation; of turns of one number any may be kept.

    The limit is applied before the shuffle too: a task sends at most ``n`` rows per conversation. That holds up to
    `MOST_TURNS`, above which Spark sorts conversations whole. Then each conversation is dealt to ``salts`` parts by a hash
    of its turns, the last ``n`` of each part are found first, and those of the conversation among them: of the longest one, of
    ``m`` turns, no task sorts more than about ``sqrt(m * n)``. Without ``salts`` its turns are counted when the frame is built.
    """
    turns = turns.select("conversation_id", "turn", "role", "text")
    if n <= MOST_TURNS and salts is None:
        return _latest(turns, n, "conversation_id")
    if salts is None:
        longest = turns.groupBy("conversation_id").count().agg(F.max("count").alias("n")).first()["n"]
        salts = salts_for(longest or 0, n)
    dealt = turns.withColumn("salt", F.pmod(F.xxhash64("turn", "role", "text"), F.lit(salts)))
    return _latest(_latest(dealt, n, "conversation_id", "salt").drop("salt"), n, "conversation_id")
