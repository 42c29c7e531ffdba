"""Reasoning levels and the request parameters they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import none_if_blank

#: Spellings of "off".
OFF_WORDS = ("off", "none", "false", "no", "0", "disable", "disabled")
#: Token budgets of levels.
BUDGETS = {"low": 1024, "medium": 4096, "high": 16384}


def normal_level(raw: Column) -> Column:
    """Lower-cased level; null for blank (the model's default); "off" for its spellings."""
    level = F.lower(none_if_blank(raw))
    return F.when(level.isin(*OFF_WORDS), "off").otherwise(level)


def request_params(provider: Column, level: Column) -> Column:
    """JSON of the parameters to merge into a request; "{}" leaves the default."""
    p = F.lower(F.coalesce(provider, F.lit("")))
    budget = F.lit(None).cast("int")
    for name, n in BUDGETS.items():
        budget = F.when(level == name, n).otherwise(budget)
    effort = F.to_json(F.struct(F.when(level == "off", "none").otherwise(level).alias("reasoning_effort")))
    think = F.when(level == "off", F.lit('{"think":false}')).otherwise(F.to_json(F.struct(level.alias("think"))))
    budgeted = F.when(budget.isNotNull(), F.to_json(F.struct(F.struct(F.lit("enabled").alias("type"), budget.alias("budget_tokens")).alias("thinking"))))
    out = F.when(p.isin("ollama-openai", "openai"), effort).when(p == "ollama", think).when(p == "anthropic", budgeted)
    return F.when(level.isNull(), "{}").otherwise(F.coalesce(out, F.lit("{}")))
