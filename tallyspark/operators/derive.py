"""Rule-driven derivation: fills gaps, supplements weak values and checks strong ones, with confidence and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RULES, Rule, names, sql

#: Least confidence of inputs to fill or supplement, to check, and that makes a target strong.
FILL, CHECK, STRONG, UNKNOWN = 0.60, 0.75, 0.70, 0.5


#: Steps from confidence to relative uncertainty. A value's band is its inputs' root of the sum of squares to
#: either side; a positive value's low is at least 0.
UNCERTAINTY = "(case when {c} >= 0.99D then 0.01D when {c} >= 0.90D then 0.03D when {c} >= 0.80D then 0.07D when {c} >= 0.70D then 0.12D else 0.20D end)"


def covenant(value: Column, low: Column, high: Column, threshold: Column) -> tuple[Column, Column]:
    """whether the band reaches over the threshold, and the headroom."""
    return ((low < threshold) & (threshold < high)) | ((value > threshold) & (low < threshold)), value - threshold


def pivot(facts: DataFrame, keys: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """One row for each key: v_<name> (double) and c_<name> for each wanted name; a value without confidence has 0.5."""
    cols = []
    for n in wanted:
        own = F.col("canonical_name") == n
        cols += [F.max(F.when(own, F.col("value"))).cast("double").alias(f"v_{n}"), F.max(F.when(own, F.coalesce("confidence", F.lit(UNKNOWN)))).alias(f"c_{n}")]
    return facts.groupBy(*keys).agg(*cols)


def derive(facts: DataFrame, keys: Sequence[str] = ("entity_id", "period"), rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule gives for each key: keys, rule_id, canonical_name, value, confidence, kind, divergence, passed, low, high.

    Rules run in the order of priority and see what earlier ones wrote. Each is a pair of expressions over one wide row
    (a new version of its target's columns), so the whole chain is one shuffle for the pivot and one projection for each
    priority, however many rules there are.
    """
    rules = sorted(rules, key=lambda r: r.priority)
    wanted = list(dict.fromkeys(n for r in rules for n in [r.target, *names(r.formula)]))
    rows, now = pivot(facts, keys, wanted), {n: n for n in wanted}  # now: suffix of each name's current columns
    results, new = [], []
    for i, r in enumerate(rules):
        ins = [now[n] for n in names(r.formula)]
        x, target, strength = f"x_{i}", f"v_{now[r.target]}", f"c_{now[r.target]}"
        strong = f"({target} is not null and {strength} >= {STRONG}D)"
        least = f"least({', '.join('c_' + n for n in ins)})" if len(ins) > 1 else f"c_{ins[0]}"
        conf = " * ".join(f"c_{n}" for n in ins) + " * 0.95D" if r.product else least
        apart = f"abs({target} - {x}) / greatest(abs({target}), abs({x}), 0.001D)"
        low = f"case when {x} > 0 then greatest({x} * (1 - b_{i}), 0D) else {x} * (1 - b_{i}) end"
        flat = "false" if r.product else f"abs({x}) < 1e-10D"  # sums near zero have no band
        new += [
            f"{sql(r.formula, lambda n: 'v_' + now[n])} as {x}",
            f"cast(round(cast(sqrt({' + '.join(f'{UNCERTAINTY.format(c=f"c_{n}")} * {UNCERTAINTY.format(c=f"c_{n}")}' for n in ins)}) as decimal(30,10)), 6) as double) as b_{i}",
            f"""named_struct('rule_id', '{r.id}', 'canonical_name', '{r.target}', 'value', {x}, 'confidence', greatest(0D, least(1D, {conf})),
                'kind', case when {' or '.join(f'v_{n} is null' for n in [*ins])} or {x} is null then null when {strong} and {least} >= {CHECK}D then 'consistency'
                when not {strong} and {least} >= {FILL}D then case when {target} is null then 'gap_fill' else 'supplement' end end,
                'divergence', {apart}, 'passed', {apart} <= {r.tolerance}D, 'low', case when not {flat} then {low} end, 'high', case when not {flat} then {x} * (1 + b_{i}) end) as r_{i}""",
        ]
        now[r.target] = f"{r.target}_{i}"
        new += [f"case when r_{i}.kind in ('gap_fill', 'supplement') then r_{i}.{of} else {was} end as {c}_{now[r.target]}" for c, of, was in (("v", "value", target), ("c", "confidence", strength))]
        results.append(f"r_{i}")
        if i + 1 == len(rules) or rules[i + 1].priority != r.priority:
            rows, new = rows.selectExpr("*", *new), []
    return rows.selectExpr(*keys, f"inline(array({', '.join(results)}))").where("kind is not null")
