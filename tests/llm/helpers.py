"""Small tables with what real ones hold: nulls, empty and blank texts, a very long one, repeated rows, clashing names."""

from __future__ import annotations

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"


def texts(n: int = 60, seed: int = 3) -> list[str | None]:
    rnd = random.Random(seed)
    words = ["the", "of", "and", "stone", "river,", "Éclair", "naïve.", "###", "a", "12", "don't", "<s>", "ﬁn", "日本", "x" * 90, " y", "z w"]
    out: list[str | None] = [None, "", " ", "\n\t ", "one", "one two", "a  b ", " lead", "▁x▁ y"]
    for _ in range(n):
        line = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))
        out.append("\n".join(line() for _ in range(rnd.randint(1, 4))))
    out.append(" ".join(rnd.choice(words) for _ in range(20_000)))
    return out + out[9:14]


def documents(spark, values: list[str | None] | None = None, first: int = 0):
    values = texts() if values is None else values
    rows = [(first + i, t, ["en", "de", None][i % 3], "hot" if i % 3 else f"s{i}", len(t or ""), 0.5, "x") for i, t in enumerate(values)]
    return spark.createDataFrame(rows + rows[-1:], KIND).repartition(3)


def by_id(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}


def broadcast_joins(df) -> list[str]:
    """The plan's inner joins that broadcast a side."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "Inner" in x]
