"""Chat formatting with typed content parts, in DataFrame and SQL functions alone.

A turn is ``<|im_start|>role\\n`` + content + ``<|im_end|>\\n``. A turn's content is text or a list of typed parts; the
visitor flattens them in order: a text part is its escaped text, an image, audio or document part is a placeholder
``<|image:0|>`` numbered in its turn, with an attachment record of its reference and the count of tokens it expands to.

Escaping keeps control strings out of texts and is reversible: ``&`` becomes ``&amp;``, ``<|`` becomes ``&lt;|`` and, in
roles, a line feed becomes ``&#10;``; undone in the opposite order. So ``<|`` in the output is always a mark, and the
typed parts can be read back from it.

A conversation is one example and so one row, gathered in one task, which has to hold it; turns are formatted before
they meet, and only strings are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinsplit.plans.names import column

START, END = "<|im_start|>", "<|im_end|>"
# Tokens that an attachment expands to, per unit of its size (image tiles, audio seconds, document pages).
EXPANDED = {"image": 256, "audio": 25, "document": 512}
PLACEHOLDER = r"<\|((?:" + "|".join(EXPANDED) + r"):\d+)\|>"
PARTS_TYPE = "array<struct<type:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of typed parts. Unknown types count as text; null parts and nulls in them are empty."""
    parts = F.coalesce(parts, F.array().cast(PARTS_TYPE))
    kinds = list(EXPANDED)
    numbered = F.transform(parts, lambda p, i: F.struct(p["type"].alias("type"), F.coalesce(p["text"], F.lit("")).alias("text"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(1)).alias("units"), F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: q["type"].isin(kinds))).alias("at")))
    content = F.array_join(F.transform(numbered, lambda p: F.when(p["type"].isin(kinds), F.concat(F.lit("<|"), p["type"], F.lit(":"), p["at"].cast("string"), F.lit("|>"))).otherwise(escape(p["text"]))), "")
    cost = F.create_map(*[x for k, v in EXPANDED.items() for x in (F.lit(k), F.lit(v))])
    attached = F.transform(F.filter(numbered, lambda p: p["type"].isin(kinds)), lambda p: F.struct(p["at"].alias("at"), p["type"].alias("type"), p["ref"].alias("ref"), (F.try_element_at(cost, p["type"]) * p["units"]).cast("long").alias("tokens")))
    return content, attached


def parse_content(content: Column) -> Column:
    """The typed parts of a turn's content, in order: (type, text, at). Neighbouring texts are one part, empty ones none."""
    marks = F.regexp_extract_all(content, F.lit(PLACEHOLDER), F.lit(1))

    def pair(t: Column, i: Column) -> Column:
        mark = F.get(marks, i)
        text = F.struct(F.lit("text").alias("type"), unescape(t).alias("text"), F.lit(None).cast("int").alias("at"))
        return F.array(text, F.struct(F.substring_index(mark, ":", 1).alias("type"), F.lit("").alias("text"), F.substring_index(mark, ":", -1).cast("int").alias("at")))

    parts = F.flatten(F.transform(F.split(content, PLACEHOLDER), pair))
    return F.filter(parts, lambda p: p["at"].isNotNull() | (p["text"] != ""))


def said(content: Column) -> Column:
    """The text of a turn's content, without its placeholders."""
    return unescape(F.regexp_replace(content, PLACEHOLDER, ""))


def _turns(formatted: Column) -> Column:
    """(role, content) of each turn of a formatted conversation."""
    marked = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        content = F.substring_index(F.substring(t, F.length(role) + 2, F.length(t)), END, 1)
        return F.struct(unescape_role(role).alias("role"), content.alias("content"))

    return F.transform(marked, turn)


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) from the output of :func:`format_conversations`: what went in, part for part.

    ``parts`` is (type, text, ref, tokens) in order; reference and tokens of an attachment are those of its record.
    """
    turns = formatted.select("conv_id", "attachments", F.posexplode(_turns(F.col("formatted"))).alias("turn", "t"))

    def full(p: Column) -> Column:
        record = F.get(F.filter("attachments", lambda a: (a["turn"] == F.col("turn")) & (a["at"] == p["at"])), F.lit(0))
        return F.struct(p["type"].alias("type"), p["text"].alias("text"), record["ref"].alias("ref"), record["tokens"].alias("tokens"))

    return turns.select("conv_id", "turn", F.col("t.role").alias("role"), F.transform(parse_content(F.col("t.content")), full).alias("parts"))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, learn_roles: tuple = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted, attachments, expanded_tokens.

    ``segments`` in order make up ``formatted``; those with loss are the contents of the turns of ``learn_roles``, to
    the character. Turns go by turn number (null first), ties by role and text; equal rows all stay. A null role or
    text counts as empty; rows of a null conv_id are a conversation. Texts may be of any length. An empty table gives no
    rows. Other columns are not looked at, whatever their names.
    """
    role = F.coalesce(column(role_col), F.lit(""))
    if parts_col:
        content, attached = flatten_parts(column(parts_col))
    else:
        content, attached = escape(F.coalesce(column(text_col), F.lit(""))), F.array().cast("array<struct<at:int,type:string,ref:string,tokens:bigint>>")
    turn = F.struct(column(turn_col).alias("turn"), escape_role(role).alias("role"), content.alias("content"), attached.alias("attachments"), role.isin(list(learn_roles)).alias("learn"))
    rows = df.select(column(conv_col).alias("conv_id"), turn.alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.array(F.struct(F.concat(F.lit(START), t["role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")), F.struct(t["content"].alias("text"), t["learn"].alias("loss")), F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss"))))
    out = convs.select("conv_id", F.flatten(pieces).alias("segments"), F.flatten(F.transform("turns", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn"), a["at"].alias("at"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"))
    out = out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return out.withColumn("expanded_tokens", F.aggregate(F.transform("attachments", lambda a: a["tokens"]), F.lit(0).cast("long"), lambda x, y: x + y)).select("conv_id", "segments", "formatted", "attachments", "expanded_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest of :func:`format_conversations`, taken from its output: turns by parsing ``formatted``, loss from the masked segments.

    Texts are those of the text parts; placeholders are no text.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    turns = _turns(F.col("formatted"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), said(t["content"]), F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: said(s["text"])), "")
    out = formatted.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), loss.alias("_loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
