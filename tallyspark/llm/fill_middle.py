"""Fill-in-the-middle rows: a text cut at two places into prefix, middle and suffix, and put together in another order.

Each Arrow batch is a table of DuckDB inside its task: one statement cuts its texts into tokens, takes the slices and
joins them again, so no row passes through Python. A text's slices need some 16 bytes for each of its tokens there; batches
are cut by bytes first, so a task holds a few MB of texts or one text. Cuts and forms follow the sha256 of the id: they are
the same in any order, partitioning or repeated run. A text that holds a marker stays plain, so a form can always be undone.

A null text is the empty text, which is plain; a null id counts as the empty id. Repeated rows have equal results. A text
of any length is one row and is cut whole. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

#: Fixed values of the form: markers, shares of plain texts and of suffix-first ones in a hundred, a token, the id's hashed text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST, TOKEN, SEED = 90, 20, "[A-Za-z]+|[^A-Za-z]", "1:"
#: Bytes of texts that one statement works on.
AT_ONCE = 1 << 21

_CUT = f"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tokens, sha256('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS digest FROM texts),
drawn AS (SELECT doc_id, text, tokens, len(tokens) AS n, list_transform([1, 9, 17, 25], lambda place: ('0x' || substr(digest, place, 8))::BIGINT) AS h FROM cut),
placed AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h[3] % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, n, form, text, array_to_string(list_slice(tokens, 1, a), '') AS prefix, array_to_string(list_slice(tokens, a + 1, b), '') AS middle, array_to_string(list_slice(tokens, b + 1, n), '') AS suffix FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM parts"""


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and the output text of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1}) as con:
            for batch in batches:
                for piece in pieces_of(batch, AT_ONCE):
                    con.register("texts", pa.Table.from_batches([piece]))
                    done = con.sql(_CUT).to_arrow_table().cast(kind)
                    con.unregister("texts")
                    yield from done.to_batches()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output was made of: the parts between its markers, each of which it holds once, back in their order."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    front, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.replace(F.substring_index(front, SUFFIX, 1), F.lit(PREFIX), F.lit("")), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.replace(F.substring_index(front, PREFIX, 1), F.lit(SUFFIX), F.lit("")))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As fill_in_middle, with lower-case sha256 of the output and of the text restored from it in place of the output."""
    made = fill_in_middle(docs, doc_id, text)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))
