"""Classification of messages by wildcard templates: the first that fits, in file order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wildcards in templates.
WILDCARD = re.compile(r"<\*>|\[\*\]")


def pattern(template: str) -> str:
    """A Java pattern: literals as they are, anything for a wildcard, anchored at the start only."""
    quoted = (r"\Q" + part.replace(r"\E", r"\E\\E\Q") + r"\E" if part else "" for part in WILDCARD.split(template))
    return "(?s)^" + ".*?".join(quoted)


def match(message: Column, templates: list[tuple[str, str]]) -> Column:
    """The event id of the first of (id, template) that fits a message, or null.

    A template's longest literal is looked for first; its pattern runs only where that stands.
    """
    if not templates:
        return F.lit(None).cast("string")
    cases = []
    for event, template in templates:
        literal = max(WILDCARD.split(template), key=len)
        fits = message.rlike(pattern(template))
        cases.append(F.when(message.contains(literal) & fits if literal else fits, F.lit(event)))
    return F.coalesce(*cases)


def classify(df: DataFrame, templates: list[tuple[str, str]], message: str = "message") -> DataFrame:
    """df with event_id: that of the template, or what was there where none fits."""
    own = F.col("event_id") if "event_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("event_id", F.coalesce(match(F.col(message), templates), own))
