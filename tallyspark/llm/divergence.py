"""How the sources of a language differ in their use of words: every two sources compared over all terms, and each source's own terms.

Terms are counted where they are read: a task keeps counts of a bounded number of (language, source, term) and sends sums.
A term's counts by source are one sparse vector, and terms with equal vectors are one row with a multiplicity: every pair
of sources is evaluated once for each distinct vector, over the sources that it holds. What a vector doesn't hold is
count 0, whose share z depends on the source alone, so with f the divergence of two shares

    sum over terms of f(p, q) = V f(z, z') + sum where p counts of f(p, z') - f(z, z') + sum where q counts of f(z, q) - f(z, z')
                                + sum where both count of f(p, q) - f(p, z') - f(z, q) + f(z, z')

and no pair of sources is visited for a term that neither has. All of it is whole numbers: counts in decimals where they are
multiplied, shares below 2^30 and their squares in longs; an overflow would be an error, not a wrong number.

Null text, language and source are empty ones. Groups without terms and languages without kept terms have their pairs, of
value 0 in the latter case. Ties in value go by the item's UTF-8 bytes. Repeated rows are documents of their own. An empty
table gives no rows. Very long texts are counted whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, as_bytes, stash

#: Fixed values of the audit: documents of a language that a kept term is in, the scale of shares, ranks of terms.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Counts that a task holds before it sends them on; rows up to which a table of groups is broadcast.
HELD, SMALL = 1 << 18, 20_000

#: Bytes to what a term is made of: A-Z become lower case, the other ASCII characters that aren't letters a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), one row each."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (of, at), (n, found) in counts.items():
                terms = list(n)
                yield arrow({"lang": ([of] * len(terms), pa.string()), "source": ([at] * len(terms), pa.string()), "term": (pa.array(terms, pa.binary()).cast(pa.string()), None), "n": (list(n.values()), pa.int64()), "docs": ([found[t] for t in terms], pa.int64())})
            counts.clear()

        for batch in batches:
            for of, at, words in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), as_bytes(batch)):
                n, found = counts[of, at]
                before, words = len(n), words.translate(_TERMS).split()
                n.update(words)
                found.update(set(words))
                held += len(n) - before
                if held > HELD:
                    yield from sent()
                    held = 0
        yield from sent()

    rows = docs.select(said(lang).alias("lang"), said(source).alias("source"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, of: str = "of", kept: str = "kept") -> str:
    """1 + floor(SCALE (n + 1) / (of + kept)); null where there are no kept terms."""
    return f"1 + ((cast({n} as decimal(18,0)) + 1) * cast({SCALE} as decimal(10,0))) div nullif(cast({of} as decimal(18,0)) + cast({kept} as decimal(18,0)), 0)"


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: in part pair each other source of the language, in part term the top terms that the source has a larger share of than its language; by value descending, then item."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = term_counts(docs, text, lang, source)
    vector = F.sort_array(F.collect_list(F.struct("source", "n")))
    terms = counts.groupBy("lang", "term").agg(vector.alias("vector"), F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    terms = stash(terms.select("lang", "term", "vector", "total"), "terms")
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_of"), F.count("*").alias("kept"))
    sums = terms.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("of"))
    groups = docs.select(said(lang).alias("lang"), said(source).alias("source")).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["of", "lang_of", "kept"]).withColumn("z", F.expr(_share("0")))
    groups = stash(groups, "groups")
    small = groups.count() <= SMALL
    of = lambda names: (F.broadcast if small else lambda x: x)(groups.select("lang", *[F.col(c).alias(a) for c, a in names.items()]))
    other = of({"source": "other", "z": "other_z"})

    # each pair that both sides count, once for each distinct vector
    distinct = stash(terms.groupBy("lang", "vector").agg(F.count("*").alias("times")), "vectors")
    one = distinct.where(F.size("vector") > 1).select("lang", "times", "vector", F.inline("vector")).join(of({"source": "source", "of": "of", "kept": "kept", "z": "z"}), ["lang", "source"])
    one = one.select("lang", "times", "source", "z", F.expr(_share("n")).alias("p"), F.explode(F.filter("vector", lambda x: x["source"] > F.col("source"))).alias("y"))
    two = one.select("lang", "times", "source", "z", "p", F.col("y.source").alias("other"), F.col("y.n").alias("n")).join(of({"source": "other", "of": "of", "kept": "kept", "z": "other_z"}), ["lang", "other"])
    two = two.select("lang", "times", "source", "other", "z", "p", "other_z", F.expr(_share("n")).alias("q"))
    more = lambda p, z, q, y: F.sum(F.expr(f"times * ({_apart(p, q)} - {_apart(p, y)} - {_apart(z, q)} + {_apart(z, y)})"))
    both = two.groupBy("lang", "source", "other").agg(more("p", "z", "q", "other_z").alias("there"), more("q", "other_z", "p", "z").alias("back"))
    both = both.select("lang", F.inline(F.array(F.struct("source", F.col("other").alias("item"), F.col("there").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))

    # what one side counts against the other's share of nothing; equal counts of a source are one row
    alone = distinct.select("lang", "times", F.inline("vector")).groupBy("lang", "source", "n").agg(F.sum("times").alias("times")).join(of({"source": "source", "of": "of", "kept": "kept", "z": "z"}), ["lang", "source"])
    alone = alone.select("lang", "source", "times", "z", F.expr(_share("n")).alias("p")).join(other, "lang").where("source != other")
    alone = alone.groupBy("lang", "source", "other").agg(F.sum(F.expr(f"times * ({_apart('p', 'other_z')} - {_apart('z', 'other_z')})")).alias("there"), F.sum(F.expr(f"times * ({_apart('other_z', 'p')} - {_apart('other_z', 'z')})")).alias("back"))
    alone = alone.select("lang", F.inline(F.array(F.struct("source", F.col("other").alias("item"), F.col("there").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))

    none = groups.join(other, "lang").where("source != other").select("lang", "source", F.col("other").alias("item"), F.expr(f"coalesce(kept * ({_apart('z', 'other_z')}), 0)").alias("value"))
    pairs = none.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    own = terms.select("lang", "term", "total", F.inline("vector")).join(of({"source": "source", "of": "of", "kept": "kept", "lang_of": "lang_of"}), ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), F.expr(_share("n")).alias("p"), F.expr(_share("total", "lang_of")).alias("q")).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(_apart("p", "q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(own)
