"""Checks whose rules come as a table: signs, positive items and relations between items, for each entity and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rule_text
from ..functions.rule_text import Name

#: Rules that are compiled into one projection; a larger table is refused, as a taxonomy has some hundred.
MOST_RULES = 5_000


def normalized(facts: DataFrame, items: DataFrame) -> DataFrame:
    """values of items of kind percentage as shares: those above 1 are hundredths. facts: item, value; items: item, kind."""
    rows = facts.join(items.select("item", "kind"), "item", "left")
    return rows.withColumn("value", F.when((F.col("kind") == "percentage") & (F.abs("value") > 1), F.col("value") / 100).otherwise(F.col("value"))).drop("kind")


def validate(facts: DataFrame, items: DataFrame, relations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C: keys, item, rule, passed, severity, actual, expected, upper, reason of each check of each item that has a value.

    facts: keys, item, value, one row each; items: item, kind, must_be_positive; relations: item, rule, tolerance, warning_only,
    optional. A rule whose sides have no value passes without an actual value (an optional one isn't there at all); a rule that
    can't be read fails as a warning (an optional one isn't there), as does a table with more than MOST_RULES. Rules are read
    once, here; each entity and period is one row of their items, and all its checks one projection. Null flags are false,
    a null tolerance 0. Arithmetic is in doubles.
    """
    listed = relations.select("item", "rule", F.coalesce("tolerance", F.lit(0.0)).alias("tolerance"), F.coalesce("warning_only", F.lit(False)).alias("warning_only"), F.coalesce("optional", F.lit(False)).alias("optional")).orderBy("item", "rule").limit(MOST_RULES + 1).collect()
    meta = items.where("kind = 'percentage' or must_be_positive").select("item", "kind", F.coalesce("must_be_positive", F.lit(False)).alias("positive")).limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES or len(meta) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    shares = {r.item for r in meta if r.kind == "percentage"}
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    null = "cast(null as double)"
    used: dict[str, None] = {}
    checks = []

    def add(item: str, rule: str, passed: str, severity: str, actual: str, low: str, high: str, reason: str, there: str) -> None:
        used[item] = None
        checks.append(f"if(`{item}` is not null and ({there}), named_struct('item', {text(item)}, 'rule', {text(rule)}, 'passed', {passed}, 'severity', '{severity}', 'actual', {actual}, 'expected', {low}, 'upper', {high}, 'reason', '{reason}'), null)")

    for r in meta:
        if r.positive:
            add(r.item, "must_be_positive", f"`{r.item}` > 0", "error", f"`{r.item}`", null, null, "checked", "true")
    for r in listed:
        severity = "warning" if r.warning_only else "error"
        try:
            tree = rule_text.rule(r.rule)
        except ValueError:
            if not r.optional:
                add(r.item, r.rule, "false", "warning", null, null, null, "unreadable", "true")
            continue
        used |= dict.fromkeys(rule_text.names(tree))
        left = tree.sides[0]
        passed, actual, low, high = rule_text.verdict(tree, r.tolerance, isinstance(left, Name) and left.name in shares)
        add(r.item, r.rule, passed, severity, actual, low, high, "checked", f"({actual}) is not null" if r.optional else "true")
    schema = "struct<item: string, rule: string, passed: boolean, severity: string, actual: double, expected: double, upper: double, reason: string>"
    found = f"filter(array({', '.join(checks)}), x -> x is not null)" if checks else f"cast(array() as array<{schema}>)"
    rows = normalized(facts, items).where(F.col("item").isin(list(used)) if used else F.lit(False))
    wide = rows.groupBy(*keys).agg(F.lit(1).alias("_"), *[F.max(F.when(F.col("item") == n, F.col("value").cast("double"))).alias(n) for n in used])
    out = wide.select(*keys, F.inline(F.expr(found)))
    # a check that could be told has an actual value, whether it held or not
    return out.withColumn("reason", F.when((F.col("reason") == "checked") & F.col("actual").isNull(), "not told").otherwise(F.col("reason")))


def summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C: checks, passed, failed, errors, warnings and what couldn't be told or read, for each of keys."""
    bad = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    return results.groupBy(*keys).agg(F.count("*").alias("total_checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), bad("error").alias("errors"), bad("warning").alias("warnings"), F.count_if(F.col("reason") == "not told").alias("not_told"), F.count_if(F.col("reason") == "unreadable").alias("unreadable"))


def signs(facts: DataFrame, items: DataFrame, hard: Sequence[str]) -> DataFrame:
    """C: facts (item, value, ...) of items with a typical_sign (positive or negative): passed, and error for hard items of the wrong sign. Zero has no sign."""
    rows = facts.join(items.where("typical_sign in ('positive', 'negative')").select("item", "typical_sign"), "item").where("value <> 0")
    ok = (F.col("value") > 0) == (F.col("typical_sign") == "positive")
    return rows.withColumn("passed", ok).withColumn("severity", F.when(F.col("item").isin(list(hard)) & ~ok, "error").otherwise("warning"))
