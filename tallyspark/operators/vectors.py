"""Labels' vectors against a small dictionary of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that one row of the dictionary may hold; a larger dictionary is refused.
MOST_ITEMS = 2_000


def cosine(a: Column, b: Column) -> Column:
    """F16: cosine of two arrays of doubles; null if one of them is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hints(vectors: DataFrame, items: DataFrame, accept: float = 0.92, show: float = 0.80, top: int = 5) -> DataFrame:
    """M: vec_id, item, score, rank, accepted for each vector's best items, none below show.

    items: item, vector; a dictionary of bounded size (checked), sent as one row, so scores need no join over pairs.
    """
    n = items.limit(MOST_ITEMS + 1).count()
    if n > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items; search an index instead")
    dictionary = items.agg(F.collect_list(F.struct("item", "vector")).alias("_items"))
    score = lambda i: F.struct((-F.round(cosine(F.col("vector"), i["vector"]), 6)).alias("near"), i["item"].alias("item"))
    best = F.slice(F.array_sort(F.filter(F.transform("_items", score), lambda s: -s["near"] >= show)), 1, top)
    found = vectors.crossJoin(F.broadcast(dictionary)).select("vec_id", F.posexplode(best).alias("_at", "_hit"))
    return found.select("vec_id", "_hit.item", (-F.col("_hit.near")).alias("score"), (F.col("_at") + 1).alias("rank"), (-F.col("_hit.near") >= accept).alias("accepted"))
