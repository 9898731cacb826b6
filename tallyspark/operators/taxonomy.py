"""Taxonomy: fuzzy matches, suggestions, hierarchy, versions, lint; patterns and aliases that are learned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import settled


#: Tasks that a segment's labels are dealt to.
SALTS = 4


def _marks(c: Column) -> list[Column]:
    """Two longs of bits, one for each character and occurrence of it; texts of an indel distance differ in no more bits."""
    chars = F.array_sort(F.split(c, ""))
    numbered = F.transform(chars, lambda x, i: F.pmod(F.xxhash64(x, i - F.array_position(chars, x).cast("int")), F.lit(128)).cast("int"))
    bits = lambda half: F.aggregate(numbered, F.lit(0).cast("long"), lambda have, k: F.when(F.floor(k / 64) == half, have.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k % 64))).otherwise(have))
    return [bits(0), bits(1)]


def _reach(n: Column, m: Column, least: float) -> Column:
    """The largest indel distance of texts of n and m characters that score least: as their lengths' difference, even or odd."""
    most = F.floor((n + m) * ((100.0 - least) / 100.0) + 1e-9).cast("int")
    return most - F.pmod(most - n + m, F.lit(2))


def fuzzy_pairs(labels: DataFrame, aliases: DataFrame, least: float = 80.0) -> DataFrame:
    """Pairs _a, _b of texts (of tables with these columns, distinct) that may have an indel similarity of least, none lost; each once.

    Texts of n and m characters that score least are t insertions and deletions apart at most. The alias is cut into t + 1
    segments at fixed places, so one of them is in the label unchanged; and for some segment that is, the i-th say, at most
    i - 1 of them lie before it and t + 1 - i behind it, which bounds how far it can have moved. So an equi-join on lengths,
    number and characters of a segment (as one hash) meets each pair. Pairs that differ in too many characters, whatever
    their order, don't come out of it.
    """
    a, b = (df.select(c).distinct().withColumn("_n", F.length(c)).where("_n > 0") for df, c in ((labels, "_a"), (aliases, "_b")))
    far = least / (200.0 - least)
    reach = lambda n: F.sequence(F.ceil(n * far - 1e-9).cast("int"), F.floor(n / far + 1e-9).cast("int"))
    lengths = lambda df: df.select(F.col("_n").alias("n")).distinct()
    both = lengths(a).select("n", F.explode(reach(F.col("n"))).alias("m")).join(lengths(b).withColumnRenamed("n", "m"), "m").withColumn("t", _reach(F.col("n"), F.col("m"), least)).where("t >= 0")
    base = F.floor(F.col("m") / (F.col("t") + 1)).cast("int")
    short = F.col("t") + 1 - F.col("m") % (F.col("t") + 1)  # segments that are a character shorter
    cut = lambda i: F.struct(i.alias("i"), ((i - 1) * base + F.greatest(F.lit(0), i - 1 - short)).alias("at"), (base + (i > short).cast("int")).alias("size"))
    cuts = both.withColumn("cuts", F.transform(F.sequence(F.lit(1), F.col("t") + 1), cut))
    # one row for each length of a text; what it may meet comes as an array, so that texts aren't multiplied before they are cut
    met = lambda of: cuts.groupBy(F.col(of).alias("_n")).agg(F.collect_list(F.struct("n", "m", "t", "cuts")).alias("met"))
    apart, t = F.col("x.n") - F.col("x.m"), F.col("x.t")
    least_shift = lambda c: F.greatest(1 - c["i"], apart - (t + 1 - c["i"]), -c["at"])
    most_shift = lambda c: F.least(c["i"] - 1, apart + t + 1 - c["i"], F.col("x.n") - c["at"] - c["size"])
    key = lambda text, c, at: F.xxhash64(F.col("x.n"), F.col("x.m"), c["i"], F.substring(text, at + 1, c["size"]))
    some = F.filter("x.cuts", lambda c: least_shift(c) <= most_shift(c))
    sought = F.array_distinct(F.flatten(F.transform(some, lambda c: F.transform(F.sequence(least_shift(c), most_shift(c)), lambda s: key(F.col("_a"), c, c["at"] + s)))))
    given = F.transform("x.cuts", lambda c: key(F.col("_b"), c, c["at"]))
    marked = lambda df, c, of: df.withColumns(dict(zip(("p", "q"), _marks(F.col(c))))).join(met(of), "_n").select(c, "p", "q", F.explode("met").alias("x"))
    left = marked(a, "_a", "n").select("_a", "p", "q", "x.t", F.explode(sought).alias("_key"))
    right = marked(b, "_b", "m").select("_b", F.col("p").alias("r"), F.col("q").alias("s"), F.explode(given).alias("_key"))
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("r"))) + F.bit_count(F.col("q").bitwiseXOR(F.col("s"))) <= F.col("t")
    # the rows are few and short, what they meet is much: spread by number, and a frequent segment over some tasks
    tasks = 4 * labels.sparkSession.sparkContext.defaultParallelism
    left = left.withColumn("_salt", F.pmod(F.xxhash64("_a"), F.lit(SALTS))).repartition(tasks, "_key", "_salt")
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)]))).repartition(tasks, "_key", "_salt")
    return left.alias("l").join(right.alias("r_"), (F.col("l._key") == F.col("r_._key")) & (F.col("l._salt") == F.col("r_._salt")) & near).select("_a", "_b").distinct()


def fuzzy_scores(labels: DataFrame, aliases: DataFrame, least: float = 80.0) -> DataFrame:
    """label, alias, score of all pairs at or above least by token-sort ratio; labels: label; aliases: alias. Texts without characters match nothing."""
    a, b = (df.select(c).distinct().withColumn(to, text.sorted_tokens(F.col(c))) for df, c, to in ((labels, "label", "_a"), (aliases, "alias", "_b")))
    near = fuzzy_pairs(a, b, least).withColumn("score", text.indel_ratio("_a", "_b")).where(F.col("score") >= least)
    return near.join(a, "_a").join(b, "_b").select("label", "alias", "score")


def fuzzy(labels: DataFrame, aliases: DataFrame, least: float = 80.0) -> DataFrame:
    """The best alias of each label at or above least, by token-sort ratio; ties to the smaller alias, then canonical. labels: label; aliases: alias, canonical_name."""
    best = fuzzy_scores(labels, aliases, least).groupBy("label").agg(F.min_by(F.struct("alias", "score"), F.struct(-F.col("score"), F.col("alias"))).alias("best"))
    names = aliases.groupBy("alias").agg(F.min("canonical_name").alias("canonical_name"))
    return best.select("label", "best.*").join(names, "alias").select("label", "alias", "canonical_name", "score")


def suggestions(scored: Sequence[tuple[DataFrame, float]], least: float = 0.6, show: float = 0.3, top: int = 5) -> DataFrame:
    """Sources (label, canonical_name, score) in order with their weights: the first that names a canonical claims it; the best top of each label."""
    rows = None
    for i, (df, weight) in enumerate(scored):
        part = df.where(F.col("score") >= least).select("label", "canonical_name", (F.col("score") * weight).alias("score"), F.lit(i).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    first = F.row_number().over(Window.partitionBy("label", "canonical_name").orderBy("source", F.desc("score")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "canonical_name"))
    return rows.withColumn("_n", first).where("_n = 1").where(F.col("score") >= show).withColumn("rank", rank).where(F.col("rank") <= top).drop("_n")


def disambiguate(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Of the canonicals that share a label's alias: the only one of the sheet's category, else the only one of least priority, else none.

    rows: label, category; aliases: alias, canonical_name, category, priority.
    """
    m = rows.join(aliases.select(F.col("alias").alias("label"), "canonical_name", F.col("category").alias("own"), "priority"), "label")
    w = Window.partitionBy("label", "category")
    same = F.col("own") == F.col("category")
    m = m.withColumns({"n_same": F.count_if(same).over(w), "lowest": F.min("priority").over(w)}).withColumn("n_low", F.count_if(F.col("priority") == F.col("lowest")).over(w))
    chosen = F.max(F.when((F.col("n_same") == 1) & same, F.col("canonical_name")).when((F.col("n_same") != 1) & (F.col("n_low") == 1) & (F.col("priority") == F.col("lowest")), F.col("canonical_name")))
    by = F.max(F.when(F.col("n_same") == 1, "category").when(F.col("n_low") == 1, "priority").otherwise("unresolved"))
    return m.groupBy("label", "category").agg(chosen.alias("canonical_name"), by.alias("resolved_by"), F.count("*").alias("candidates"))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """P: aliases that name more than one canonical."""
    return aliases.groupBy("alias").agg(F.count_distinct("canonical_name").alias("n"), F.array_join(F.array_sort(F.collect_set("canonical_name")), "|").alias("names")).where("n > 1")


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """canonical_name, change, aliases added and removed; old and new: canonical_name, display, aliases (array)."""
    a = old.select("canonical_name", F.col("display").alias("d0"), F.col("aliases").alias("a0"), F.lit(1).alias("_0"))
    b = new.select("canonical_name", F.col("display").alias("d1"), F.col("aliases").alias("a1"), F.lit(1).alias("_1"))
    none = F.array().cast("array<string>")
    joined = lambda x, y: F.array_join(F.array_sort(F.array_except(F.coalesce(x, none), F.coalesce(y, none))), "|")
    change = F.when(F.col("_0").isNull(), "added").when(F.col("_1").isNull(), "removed").when(~F.col("d0").eqNullSafe(F.col("d1")) | (F.array_sort("a0") != F.array_sort("a1")), "changed").otherwise("same")
    return a.join(b, "canonical_name", "full").select("canonical_name", change.alias("change"), joined(F.col("a1"), F.col("a0")).alias("aliases_added"), joined(F.col("a0"), F.col("a1")).alias("aliases_removed"))


def levels(edges: DataFrame) -> DataFrame:
    """K/J: node, parent, level, root, path and ancestors (an array from the root to the node) of a forest; a parent that isn't there makes a root.

    Pointer doubling: each round joins what lies above a node's topmost known ancestor, so that as many rounds are needed as
    the depth has binary digits, whatever the depth and the number of nodes. Nodes of a cycle, and below one, have no level,
    root, path or ancestors. edges: node (once each), parent.
    """
    nodes = edges.select(F.col("node").alias("parent")).distinct().withColumn("_known", F.lit(True))
    edges = settled(edges.join(nodes, "parent", "left").select("node", F.when(F.col("_known"), F.col("parent")).alias("parent")))
    state, most, reach = edges.select("node", F.col("parent").alias("up"), F.array("node").alias("ancestors")), edges.count(), 1
    while reach <= most and not state.where("up is not null").isEmpty():
        over = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("ancestors").alias("above"))
        above = F.coalesce("above", F.array().cast("array<string>"))
        state = settled(state.join(over, "up", "left").select("node", F.col("next").alias("up"), F.concat(above, "ancestors").alias("ancestors")))
        reach *= 2
    found = F.when(F.col("up").isNull(), F.col("ancestors"))
    rows = edges.join(state, "node").withColumn("ancestors", found)
    return rows.select("node", "parent", (F.size("ancestors") - 1).alias("level"), F.col("ancestors")[0].alias("root"), F.array_join("ancestors", "/").alias("path"), "ancestors")


def subtotals(tree: DataFrame, values: DataFrame) -> DataFrame:
    """J/H5: a node's own value, else the sum of the nearest valued nodes below it.

    A valued node counts for an ancestor if none that lies between has a value. tree: node and ancestors.
    """
    valued = values.where("value is not null").select("node", "value")
    up = tree.join(valued, "node").select("node", "value", F.posexplode("ancestors").alias("i", "ancestor"))
    blocked = up.join(valued.select(F.col("node").alias("ancestor"), F.lit(1).alias("has")), "ancestor", "left")
    last = F.max(F.when((F.col("has") == 1) & (F.col("ancestor") != F.col("node")), F.col("i"))).over(Window.partitionBy("node"))
    reach = blocked.withColumn("stop", F.coalesce(last, F.lit(-1))).where((F.col("ancestor") == F.col("node")) | (F.col("has").isNull() & (F.col("i") > F.col("stop"))))
    return reach.groupBy(F.col("ancestor").alias("node")).agg(F.sum("value").alias("value"), F.max(F.when(F.col("ancestor") == F.col("node"), True).otherwise(False)).alias("own"))


def fold_patterns(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An ordered stream of upserts in closed form: the greatest confidence, the canonical that reached it first, all occurrences.

    rows: keys, canonical_name, confidence, count, seq (0 for what is stored).
    """
    first = F.min_by("canonical_name", F.struct(-F.col("confidence"), "seq"))
    return rows.groupBy(*keys).agg(first.alias("canonical_name"), F.max("confidence").alias("confidence"), F.sum("count").alias("occurrences"))


def fold_aliases(rows: DataFrame) -> DataFrame:
    """Weighted occurrences and sorted source entities of each alias."""
    return rows.groupBy("canonical_name", "alias").agg(F.sum("weight").alias("occurrences"), F.array_sort(F.collect_set("entity")).alias("entities"))


def promotable(aliases: DataFrame, count: int = 3, entities: int = 2) -> DataFrame:
    """I: enough occurrences from enough entities."""
    return aliases.where((F.col("occurrences") >= count) & (F.size("entities") >= entities))


def stale(last_seen: Column, today: Column, days: int = 180) -> Column:
    """Not seen for days; never seen counts as stale."""
    return last_seen.isNull() | (F.date_diff(today, last_seen) > days)


def cascade(labels: DataFrame, stages: Sequence[tuple[str, DataFrame, float]]) -> DataFrame:
    """Q: each label's name by the first stage that knows it well enough: label, canonical_name, confidence, method; unmapped with confidence 0 if none does.

    stages: method, frame of label, canonical_name, confidence, and the least confidence, in order. Of a stage's rows for a
    label the surest counts, of equals the first by name. Labels of null have no row.
    """
    rows = None
    for i, (method, frame, least) in enumerate(stages):
        part = frame.where(F.col("confidence") >= least).select("label", "canonical_name", "confidence", F.lit(method).alias("method"), F.lit(i).alias("_stage"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("label").agg(F.min_by(F.struct("canonical_name", "confidence", "method"), F.struct("_stage", -F.col("confidence"), "canonical_name")).alias("_best"))
    found = labels.select("label").distinct().where("label is not null").join(best, "label", "left")
    return found.select("label", F.coalesce("_best.canonical_name", F.lit("unmapped")).alias("canonical_name"), F.coalesce("_best.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("_best.method", F.lit("none")).alias("method"))


def remapped(old: DataFrame, new: DataFrame) -> DataFrame:
    """Q: mappings after a second pass, which replaces only what it is surer of; a second pass that unmaps changes nothing."""
    n = new.select("label", F.col("canonical_name").alias("_name"), F.col("confidence").alias("_sure"))
    better = F.coalesce((F.col("_sure") > F.col("confidence")) & (F.col("_name") != "unmapped"), F.lit(False))
    rows = old.join(n, "label", "left").withColumn("_better", better)
    return rows.select("label", F.when(F.col("_better"), F.col("_name")).otherwise(F.col("canonical_name")).alias("canonical_name"), F.when(F.col("_better"), F.col("_sure")).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("_better"), "remapped").otherwise(F.col("method")).alias("method"))
