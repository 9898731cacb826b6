"""Quotation linking: quoted passages are joined to the messages they come from, and conversations follow their replies.

Parsing. A line's quote level is the number of ">" marks it begins with. Lines of one level in a row are a passage;
level 0 is the message's own text, from which a line that only introduces a quotation ("... wrote:") is taken away.
Passages and own texts are normalised (lower case, single spaces) and hashed to 128 bits, as a whole, by paragraphs and
by lines; parts of less than min_words words only count as a whole.

Linking. A part's original is the earliest message of the same conversation that has the part in its own text, if it is
earlier than the quoting message; else the earliest of all messages, if that is earlier by (conv_id, turn). So links
never form a cycle, and the join gets one row for each hash: common passages aren't multiplied. A message's parent is the
original of its passage of the lowest level, then the longest part, then the latest original. Where follow asks for it, a
message without such an original answers the one before it in its conversation.

Ordering. Roots and depths come from pointer doubling over parents; where messages follow, over the heads of runs only,
which are turns that quote: those behind a head are counted. Rows are ordered by root, depth, and message, which
puts replies behind what they answer; a conversation of any size spreads over the sort's tasks.

Null and empty texts have no parts. Messages without conv_id or turn are roots of their own and nobody's original.
Repeated rows each have a result. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, as_text, slices, stash

_MARKS = re.compile(r"\s*((?:>\s?)+)")
_WROTE = re.compile(r"\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.I)


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines without marks) of each run of lines of one level."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(rest)
    for (level, lines), after in zip(out, out[1:]):
        if after[0] > level:
            while lines and not lines[-1].strip():
                lines.pop()
            if lines and _WROTE.search(lines[-1]):
                lines.pop()
    return [x for x in out if any(y.strip() for y in x[1])]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def parts(lines: list[str], min_words: int) -> dict[str, int]:
    """Normalised parts of a passage, with their words: all of it, its paragraphs and its lines."""
    whole = normal("\n".join(lines))
    out = {whole: len(whole.split())} if whole else {}
    for part in [*"\n".join(x.strip() for x in lines).split("\n\n"), *lines]:
        part = normal(part)
        if (n := len(part.split())) >= min_words:
            out.setdefault(part, n)
    return out


def own_text(found: list[tuple[int, list[str]]]) -> str:
    return "\n".join("\n".join(lines).strip("\n") for level, lines in found if level == 0).strip()


def _parse(min_words: int):
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"level": pa.int32(), "words": pa.int32(), "hash": pa.binary()}))
        for batch in slices(batches):
            texts, out, quoted = [], [], []
            for text in as_text(batch):
                found = passages(text)
                texts.append(own_text(found))
                own = parts(texts[-1].split("\n"), min_words)
                rows = [(0, n, h) for h, n in own.items()]
                for level, lines in found:
                    if level:
                        rows += [(level, n, h) for h, n in parts(lines, min_words).items()]
                    else:
                        rows += [(0, n, h) for h, n in parts(lines, min_words).items() if h not in own]
                quoted.append(sum(level > 0 for level, _ in found))
                out.append([{"level": a, "words": n, "hash": xxh3_128_digest(h.encode())} for a, n, h in rows])
            yield arrow({"conv_id": (batch.column("conv_id"), None), "turn": (batch.column("turn"), None), "role": (batch.column("role"), None), "text": (texts, pa.string()), "n_quoted": (quoted, pa.int32()), "parts": (out, kind)})

    return run


def link_quotes(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", min_words: int = 3, follow: bool = False) -> DataFrame:
    """conv_id, turn, role, text (without quotations), n_quoted (passages), parent_conv, parent_turn, root_conv, root_turn, depth; in reply order."""
    rows = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    parsed = stash(rows.mapInArrow(_parse(min_words), "conv_id long, turn long, role string, text string, n_quoted int, parts array<struct<level: int, words: int, hash: binary>>"), "messages")
    part = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.inline("parts"))
    own, quoted = part.where("level = 0"), part.where("level > 0")
    here = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("here"))
    anywhere = own.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("anywhere"))
    me = F.struct("conv_id", "turn")
    found = quoted.join(here, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
    original = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn"))).when(F.col("anywhere") < me, F.col("anywhere"))
    best = F.max_by("original", F.struct(-F.col("level"), "words", "original"))
    parents = stash(found.withColumn("original", original).where("original is not null").groupBy("conv_id", "turn").agg(best.alias("up")), "parents")
    link = lambda df, root, depth: df.select(F.struct("conv_id", "turn").alias("node"), root.alias("root"), depth.alias("depth"))
    if follow:
        turns = stash(_runs(parsed, parents), "turns")
        parents = turns.where("up is not null or before is not null").select("conv_id", "turn", F.coalesce("up", F.struct("conv_id", F.col("before").alias("turn"))).alias("up"))
        heads = turns.where("up is not null").select("conv_id", "turn", "up.*").toDF("conv_id", "turn", "at_conv", "at_turn")
        at = turns.select(F.col("conv_id").alias("at_conv"), F.col("turn").alias("at_turn"), "head", "offset")
        linked = _roots(link(heads.join(at, ["at_conv", "at_turn"]), F.struct(F.col("at_conv").alias("conv_id"), F.col("head").alias("turn")), F.col("offset") + 1))
        # a run may hold a large share of all rows: its root comes to its pieces, and from these to the turns
        pieces = turns.select("conv_id", "piece", "head").distinct()
        linked = linked.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("head"), "root", "depth")
        placed = turns.join(pieces.join(linked, ["conv_id", "head"]), ["conv_id", "piece", "head"], "left")
        roots = link(placed, F.coalesce("root", F.struct("conv_id", F.col("head").alias("turn"))), (F.col("offset") + F.coalesce("depth", F.lit(0))).cast("int"))
    else:
        roots = _roots(link(parents, F.col("up"), F.lit(1)))
    out = parsed.join(parents, ["conv_id", "turn"], "left").join(roots.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), "root", "depth"), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", "n_quoted", F.col("up.conv_id").alias("parent_conv"), F.col("up.turn").alias("parent_turn"),
        F.coalesce("root.conv_id", "conv_id").alias("root_conv"), F.coalesce("root.turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    ).orderBy("root_conv", "root_turn", "depth", "conv_id", "turn")


def _runs(messages: DataFrame, parents: DataFrame, piece: int = 1024) -> DataFrame:
    """conv_id, turn, piece, up (from parents), the turn before it, and the head of its run, with the turns between as offset.

    A run is a turn that quotes, or a conversation's first one, with the turns behind it up to the next that quotes. Turns are
    ordered and counted in pieces, and pieces after that, as a conversation may hold a large share of all rows.
    """
    turns = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct().withColumn("piece", F.floor(F.col("turn") / piece))
    turns = turns.join(parents, ["conv_id", "turn"], "left")
    inside = Window.partitionBy("conv_id", "piece").orderBy("turn")
    turns = turns.withColumn("i", F.row_number().over(inside)).withColumns({"near": F.lag("turn").over(inside), "own": F.max(F.when(F.col("up").isNotNull(), F.struct("i", "turn"))).over(inside)})
    sums = turns.groupBy("conv_id", "piece").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.max("own").alias("own"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("done", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    head = F.when(F.col("own").isNotNull(), F.struct((F.col("done") + F.col("own.i")).alias("i"), F.col("own.turn").alias("turn")))
    far = F.coalesce(F.max(head).over(earlier), F.struct(F.lit(1).cast("long").alias("i"), F.coalesce(F.min("first").over(earlier), F.col("first")).alias("turn")))
    sums = sums.select("conv_id", "piece", "done", F.lag("last").over(Window.partitionBy("conv_id").orderBy("piece")).alias("last"), far.alias("far"))
    rows = turns.join(sums, ["conv_id", "piece"])
    at = F.coalesce(F.col("done") + F.col("own.i"), F.col("far.i"))
    return rows.select("conv_id", "turn", "piece", "up", F.coalesce("near", "last").alias("before"), F.coalesce("own.turn", "far.turn").alias("head"), (F.col("done") + F.col("i") - at).alias("offset"))


def _roots(up: DataFrame) -> DataFrame:
    """Pointer doubling: node, its root and the links between."""
    up = stash(up, "up")
    while not up.isEmpty():
        over = up.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        jumped = stash(up.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "up")
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    return up
