"""Registered queries of the corpus operators and their DuckDB SQL, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import ann, bpe, chat, exact_dedup, html_text, lang_id, minhash, packing, quality, url_filter
from statloom.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.identify(docs, lang_id.learn(docs))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, url_filter.LISTED))).alias("url"))
    return url_filter.url_filter(table(spark, sf_dir, "pages"), listed)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"))


def tokenizer_path() -> str:
    """The public vocabulary that the registered queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return chat.read_chat(chat.format_chat(rows.unionByName(added)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _url_sql() -> str:
    ways = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    fits = [f"((host = '{t[: t.index('/')]}' OR ends_with(host, '.{t[: t.index('/')]}')) AND starts_with(path, '{t[t.index('/') :]}'))" for _, t in ways]
    rule = " ".join(f"WHEN {f} THEN '{t}'" for f, (_, t) in zip(fits, ways, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _) in zip(fits, ways, strict=True))
    listed = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in url_filter.LISTED)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

CHAT_SQL = """
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  length(role) + length(text) + 24
  + 4 * (length(role || text) - length(replace(role || text, '&', '')))
  + 3 * (length(role || text) - length(replace(role || text, '<', '')))
  + 4 * (length(role || text) - length(replace(role || text, '[', ''))) AS n FROM every)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id,
        op2_url_filter,
        op3_nearest_neighbours,
        op4_bpe_round_trip,
        op5_exact_dedup,
        op6_html_text,
        op7_chat_format,
        op8_minhash_near_dedup,
        op9_packing,
        op10_quality_classifier,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _url_sql(), "op5_exact_dedup": EXACT_SQL, "op7_chat_format": CHAT_SQL}
