"""The operators' queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fill_middle, lm, multi_index, packing, part_enum, quality_rules, quotes, rule_ensemble, simhash, token_counts, toxicity
from .common import crc_mod, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"), follow=True)


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = rule_ensemble.fit_quality(docs, labels, crc_mod("_id", 3) != 1)
    return rule_ensemble.score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.adaptive_rules(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum.similar_texts(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_multi_index, op2_quotation_links, op3_rule_ensemble, op4_token_counts, op5_quality_rules, op6_packing, op7_simhash, op8_toxicity, op9_sentencepiece, op10_backoff_lm, op11_fill_middle, op12_part_enum, op13_source_divergence)}
#: Cuts by places of characters instead of joined slices, and the restored text by places in the output.
FILL_MIDDLE_SQL = r"""
WITH read AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
cut AS (SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS lens,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM read),
placed AS (SELECT *, len(lens)::BIGINT AS n, least(h1 % (len(lens) + 1), h2 % (len(lens) + 1)) AS a, greatest(h1 % (len(lens) + 1), h2 % (len(lens) + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
sized AS (SELECT *, coalesce(list_sum(lens[1:a]), 0)::BIGINT AS p, coalesce(list_sum(lens[a + 1:b]), 0)::BIGINT AS m FROM placed),
made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, p) || '<S>' || substr(text, p + m + 1) || '<M>' || substr(text, p + 1, m)
  ELSE '<S>' || substr(text, p + m + 1) || '<P>' || substr(text, 1, p) || '<M>' || substr(text, p + 1, m) END AS output FROM sized),
found AS (SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, at_s - 4) || substr(output, at_m + 3) || substr(output, at_s + 3, at_m - at_s - 3)
    ELSE substr(output, at_p + 3, at_m - at_p - 3) || substr(output, at_m + 3) || substr(output, 4, at_p - 4) END) AS restored_sha256
FROM found"""

#: Every term, group and pair of groups written out.
DIVERGENCE_SQL = r"""
WITH read AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
said AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM read),
kept AS (SELECT lang, term, count(*) AS total FROM said GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
had AS (SELECT s.lang, s.source, s.term, count(*) AS n FROM said s JOIN kept k ON k.lang = s.lang AND k.term = s.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM read),
sums AS (SELECT lang, source, sum(n) AS of FROM had GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS of FROM kept GROUP BY lang),
shares AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (coalesce(s.of, 0) + l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (l.of + l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN had h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
compared AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(c.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN compared c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {"op11_fill_middle": FILL_MIDDLE_SQL, "op13_source_divergence": DIVERGENCE_SQL}
