"""Quality classifier: an interpolated modified Kneser-Ney model of real characters, trained on trusted text.

Counts cover all trusted documents and the model grows with them: `ngram_model` keeps n-grams of real characters in
tables sharded by n-gram and scores documents by joining their n-grams with these. A document's perplexity is the
exponential of minus its mean log probability per character, over its whole text; trusted documents are scored by the
half of the trusted text that they are not in.

A document is rejected if its log perplexity lies outside limits of its language and length band (powers of two of the
number of characters): the median of trusted documents there, minus `stretch` times the distance from the lower
quantile to the median, and plus `stretch` times the distance from the median to the upper quantile. Symbol noise
and shouting rise above. Repetition is seen by a document's freshness, the share of its characters that end an n-gram new
to the document, which has a lower limit of the same kind. Every cell has limits, however few its trusted documents: the three
figures of a cell with n trusted documents are weighted n to `least` with those of its language over all bands, and these
likewise with those of all languages together, so they move from the pooled to the own figures without a switch.

Defined results: a null or empty text has null perplexity and is rejected; a null language is a language of its own, equal
to the empty one; labels that repeat count once, labels without a document count nothing; rows that repeat an id or a text
are judged each; without trusted text every other document is kept; very long texts are worked off in chunks, whole; an
empty table gives no rows; further columns are ignored by `classify` and carried along by `accepted_rows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm import ngram_model
from statloom.llm.common import drop_tables, shared_table

QUANTILES = (0.05, 0.5, 0.95)
#: Bins of log perplexity to 1.
BINS = 1000


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    return labels.where((F.col(quality_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("trusted")).distinct()


def band(chars):
    return F.floor(F.log2(F.greatest(chars, F.lit(1)))).cast("int")


def _spread(bins: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, and a struct `name` of n, mid, down and up: trusted documents of a group and the quantiles of their figure."""
    # Quantiles of counts by bin: the same on every run, combined before the shuffle, and a group holds its bins, not its documents.
    each = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.percentile("bin", F.array(*map(F.lit, QUANTILES)), F.col("n")).alias("q"))
    q = [(F.col("q")[i] + 0.5) / BINS for i in range(len(QUANTILES))]
    return each.select(*by, F.struct("n", q[1].alias("mid"), (q[1] - q[0]).alias("down"), (q[2] - q[1]).alias("up")).alias(name))


def limits(scores: DataFrame, stretch: float, least: int) -> DataFrame:
    """(l, b, low, high, fresh_low): limits of log perplexity and log freshness for each language and band of the scores."""
    fresh = _limits(scores, F.ln("fresh"), stretch, least).select("l", "b", F.col("low").alias("fresh_low"))
    return _limits(scores, F.col("log_ppl"), stretch, least).join(fresh, ["l", "b"])


def _limits(scores: DataFrame, value, stretch: float, least: int) -> DataFrame:
    known = scores.where(F.col("log_ppl").isNotNull())
    good = known.where("good")
    bins = good.groupBy("l", "b", F.floor(value * BINS).alias("bin")).agg(F.count("*").alias("n"))
    # Languages times at most 64 bands: a small table whatever the corpus.
    cells = known.select("l", "b").distinct().join(_spread(bins, ["l", "b"], "band"), ["l", "b"], "left")
    cells = cells.join(_spread(bins, ["l"], "language"), "l", "left").join(_spread(bins, [], "every"), how="left")

    def pooled(part: str):
        value = F.col("every")[part]
        for level in ("language", "band"):
            n = F.col(level)["n"]
            value = F.coalesce((n * F.col(level)[part] + least * value) / (n + least), value)
        return value

    return cells.select("l", "b", (pooled("mid") - stretch * pooled("down")).alias("low"), (pooled("mid") + stretch * pooled("up")).alias("high"))


def _scored(rows: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(blocks of the rows, their block, seq, pos, doc_id, l, good, chars, log_ppl, fresh and b)."""
    columns = rows.columns
    held = ngram_model.blocks(rows, id_col, text_col)
    good = ngram_model.trusted_places(held, trusted_ids(labels, id_col))
    asked = ngram_model.questions(held, good, id_col, text_col, columns)
    known = ngram_model.answers(asked)
    found = ngram_model.scores(held, asked, known, good, id_col, text_col, lang_col, columns, rows.schema[id_col].dataType.simpleString())
    found = shared_table(found.withColumn("b", band(F.col("chars"))), "scores")
    drop_tables([good, asked, known])
    return held, found


def _verdict(log_ppl):
    inside = log_ppl.isNotNull() & F.coalesce(log_ppl >= F.col("low"), F.lit(True)) & F.coalesce(log_ppl <= F.col("high"), F.lit(True))
    return inside & F.coalesce(F.ln("fresh") >= F.col("fresh_low"), F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", stretch: float = 3.5, least: int = 50) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, low, high, fresh, fresh_low, kept for every row; low and high limit perplexity."""
    held, scores = _scored(docs.select(id_col, text_col, F.col(lang_col).cast("string").alias(lang_col)), labels, id_col, text_col, lang_col)
    drop_tables([held])
    bounds = shared_table(limits(scores, stretch, least), "limits")
    out = scores.join(bounds, ["l", "b"], "left")
    return out.select(
        "doc_id",
        F.col("l").alias("lang"),
        F.col("chars").alias("n_chars"),
        F.exp("log_ppl").alias("perplexity"),
        F.exp("low").alias("low"),
        F.exp("high").alias("high"),
        "fresh",
        F.exp("fresh_low").alias("fresh_low"),
        _verdict(F.col("log_ppl")).alias("kept"),
    )


def accepted_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", stretch: float = 3.5, least: int = 50) -> DataFrame:
    """The rows that `classify` keeps, with all their columns."""
    held, scores = _scored(docs, labels, id_col, text_col, lang_col)
    bounds = shared_table(limits(scores, stretch, least), "limits")
    kept = scores.join(bounds, ["l", "b"], "left").where(_verdict(F.col("log_ppl"))).select("block", "seq", "pos")
    return ngram_model.rows_at(held, kept, docs.schema)
