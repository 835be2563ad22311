"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is an array of parts (kind, text, ref, units). The visitor `_visit` flattens parts in order: text is
escaped, image, audio and document parts become one placeholder each. Attachments keep their turn, position, kind,
reference and the number of tokens that the placeholder stands for (units times TOKENS_PER_UNIT, rounded up).

Template of a turn: <|turn|>ROLE<|body|>BODY<|end|>\\n. In roles and texts & < [ are written as &amp; &lt; &#91;, so no
control string of this or another bracket-style template can appear inside a text, and reading back undoes it.

Rows of a conversation are ordered by turn, then role, then text (ties and repeated rows are all kept). Defined
results: null role, text or kind count as empty and text; texts of any length are kept whole; null turns come first; null conv_id is a conversation of its
own; an empty table gives no rows; further columns are ignored. A conversation becomes one string by contract, so its
rows meet in one task; offsets come from a window there, in time proportional to its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,units:double>"
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
OTHER = "<|attachment|>"
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """A plain text as an array of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _is_text(part: Column) -> Column:
    return part["kind"].isNull() | (part["kind"] == "text")


def _visit(part: Column) -> Column:
    out = F.lit(OTHER)
    for k in TOKENS_PER_UNIT:
        out = F.when(part["kind"] == k, F.lit(f"<|{k}|>")).otherwise(out)
    return F.when(_is_text(part), escape(part["text"])).otherwise(out)


def _expanded(part: Column) -> Column:
    tokens = F.lit(0).cast("long")
    for k, n in TOKENS_PER_UNIT.items():
        units = F.greatest(F.coalesce(part["units"], F.lit(1.0)), F.lit(0.0))
        tokens = F.when(part["kind"] == k, F.ceil(units * n).cast("long")).otherwise(tokens)
    return tokens


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns (pos, start, loss_start, loss_len), attachments, expanded_tokens.

    content_col is a string or an array of PART. Offsets and lengths are in code points of `formatted`.
    """
    plain = dict(df.dtypes)[content_col] == "string"
    content = F.col(content_col)
    parts = text_parts(content) if plain else F.coalesce(content, F.array().cast(f"array<{PART}>"))
    order = content if plain else F.to_json(parts)
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"), order.alias("tie"))
    rows = rows.withColumn("body", F.array_join(F.transform("parts", _visit), "")).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    rows = rows.withColumn("pos", F.row_number().over(by).cast("long"))
    rows = rows.withColumn("start", F.sum(size.cast("long")).over(Window.partitionBy("conv_id").orderBy("turn", "role", "tie").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    held = F.transform(
        F.col("parts"),
        lambda p, i: F.struct(F.col("pos").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens")),
    )
    rows = rows.withColumn("files", F.filter(held, lambda a: ~_is_text(a)))
    loss = F.col("role") == loss_role
    turn = F.struct(
        "pos",
        "start",
        (F.col("start") + F.when(loss, F.length("head")).otherwise(0)).alias("loss_start"),
        F.when(loss, F.length("body")).otherwise(0).cast("long").alias("loss_len"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        "files",
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    whole = whole.withColumn("attachments", F.flatten(F.transform("turns", lambda t: t["files"])))
    whole = whole.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))
    spans = F.transform("turns", lambda t: F.struct(t["pos"].alias("pos"), t["start"].alias("start"), t["loss_start"].alias("loss_start"), t["loss_len"].alias("loss_len")))
    return whole.select("conv_id", "formatted", spans.alias("turns"), "attachments", "expanded_tokens")


def read_chat(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted strings and their loss spans alone."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 2**31 - 1)
    read = formatted.select("conv_id", "formatted", "turns", pieces.alias("pieces"))

    def said(p: Column) -> Column:
        body = F.substring_index(F.substr(p, F.instr(p, BODY) + len(BODY)), END, 1)
        return F.concat(unescape(F.substring_index(p, BODY, 1)), F.lit("\n"), unescape(body), F.lit("\n"))

    def under(p: Column, t: Column) -> Column:
        inside = (t["loss_start"] - t["start"] - F.lit(len(TURN)) + 1).cast("int")
        return F.when(t["loss_len"] > 0, unescape(F.substr(p, inside, t["loss_len"].cast("int")))).otherwise(F.lit(""))

    read = read.withColumn("loss", F.array_join(F.zip_with("pieces", "turns", under), ""))
    return read.select(
        "conv_id",
        F.size("pieces").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("pieces", said), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
