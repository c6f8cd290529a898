"""What an action may do: capability decisions and result classes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decide(rules: dict[str, str], action: str, dry_run: str) -> Column:
    """allow, confirm or deny by class of action; what has no rule is denied, and a dry
    run of what needs confirming is allowed."""
    out = F.lit("deny")
    for name, decision in rules.items():
        one = F.when(F.col(dry_run), "allow").otherwise("confirm") if decision == "confirm" else F.lit(decision)
        out = F.when(F.col(action) == name, one).otherwise(out)
    return out


def result_of(error, denied) -> Column:
    return F.when(denied, "denied").when(error.isNotNull() & (error != ""), "error").otherwise("success")


def argument_summary(arguments: Column, large: list[str], most: int = 100) -> Column:
    """A map of arguments for a log: sizes only of large ones, others cut short."""
    return F.transform_values(arguments, lambda k, v: F.when(k.isin(large), F.concat(F.lit("<"), F.length(v).cast("string"), F.lit(" chars>"))).when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v))
