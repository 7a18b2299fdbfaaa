"""Score, status, grade and ordering expressions.

A score is a double in 0..1; -1 marks information, -2 an insight, null unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFO = -1.0
INSIGHT = -2.0

# Letter grades from best to worst.
GRADES = ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "F"]

# Order in which a report lists its sections.
STATUSES = ["FAIL", "WARN", "PASS", "INFO", "INSIGHT", "UNKNOWN"]


def status(score: Column) -> Column:
    return (
        F.when(score.isNull(), "UNKNOWN")
        .when(score == INSIGHT, "INSIGHT")
        .when(score == INFO, "INFO")
        .when(score < 0.5, "FAIL")
        .when(score < 0.9, "WARN")
        .otherwise("PASS")
    )


def sort_key(score: Column) -> Column:
    """Worst scores first, then information, insights and unknowns."""
    return (
        F.when(score.isNull(), 100.0)
        .when(score == INSIGHT, 99.0)
        .when(score == INFO, 98.0)
        .otherwise(score)
    )


def grade(score: Column, bottom: float = 0.25, top: float = 1.0) -> Column:
    """Letter grade on an even scale between ``bottom`` and ``top``; ``?`` for null."""
    letters = F.array(*[F.lit(g) for g in GRADES])
    steps = len(GRADES) - 2
    level = F.ceil(F.lit(steps + 1.0) - (score - bottom) / F.lit(top - bottom) * steps)
    return (
        F.when(score.isNull(), "?")
        .when(score >= top, GRADES[0])
        .when(score < bottom, GRADES[-1])
        .otherwise(F.element_at(letters, level.cast("int")))
    )
