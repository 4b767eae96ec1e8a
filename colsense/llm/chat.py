"""Chat formatting: typed content parts to one text with a loss mask.

A message is a row (conv_id, turn, role, parts).  Visiting its parts in order
gives text as it is (escaped), and a placeholder for each image, audio or
document, which is recorded as an attachment with the number of tokens that it
will take.  DataFrame functions only.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  No text or role can
hold a control string: ``<`` followed by backslashes and ``|`` gets one more
backslash, and a line break in a role becomes ``<|nl|>``.  Taking that away
again gives the original, so the output can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: type is text, image, audio or document; other types and null give nothing.
PART = ("struct<type: string, text: string, ref: string, width: int, height: int, "
        "duration_ms: long, pages: int>")
ATTACHMENT = "array<struct<turn: long, part: int, type: string, ref: string, tokens: long>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def text_parts(text: Column | str) -> Column:
    """The parts of a message that is one text; null is the empty text."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null("string").alias("ref"),
        null("int").alias("width"), null("int").alias("height"), null("long").alias("duration_ms"),
        null("int").alias("pages")))


def expanded_tokens(part: Column, patch: int, audio_ms: int, page_tokens: int) -> Column:
    """Tokens that the placeholder of ``part`` stands for: image patches, audio
    frames or pages; what is not known counts as one unit."""
    up = lambda x, unit: F.ceil(F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) / unit)
    return (F.when(part["type"] == "image", up(part["width"], patch) * up(part["height"], patch))
            .when(part["type"] == "audio", up(part["duration_ms"], audio_ms))
            .when(part["type"] == "document", up(part["pages"], 1) * page_tokens).cast("long"))


def visit(part: Column) -> Column:
    """What a part puts into the text."""
    out = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind, mark in PLACEHOLDER.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise("")


def format_chat(messages: DataFrame, trained: tuple[str, ...] = ("assistant",), patch: int = 28,
                audio_ms: int = 40, page_tokens: int = 1024) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_mask`` (for
    each trained turn its number from 0, start and end, in code points of
    ``formatted``), ``turn_starts`` (of all turns), ``attachments`` (in order,
    with their expanded tokens) and ``expanded_tokens`` (their sum).

    ``messages`` has conv_id, turn, role and ``parts`` (array of ``PART``; null:
    none).  Turns go by ``turn``, nulls first; equal turns by role, then by
    content, so repeated rows all stay and the order is fixed.  A null role is
    the empty role; a null conv_id is a conversation.  Other columns are
    ignored; an empty table gives an empty one.  Every turn is visited and
    measured on its own; a conversation is put together once, as the one value
    that it has to be, after the shuffle by conv_id that the running start uses.
    """
    body = F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit), "")
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    visits = F.filter(F.transform("parts", lambda p, i: F.struct(
        F.col("turn").cast("long").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"),
        expanded_tokens(p, patch, audio_ms, page_tokens).alias("tokens"))), lambda a: a["tokens"].isNotNull())
    turns = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", head.alias("head"), body.alias("body"),
                            F.coalesce(visits, F.array().cast(ATTACHMENT)).alias("attached"))
    turns = turns.withColumn("chars", F.char_length("head") + F.char_length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "body")
    start = F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select("*", (F.row_number().over(order) - 1).alias("n"), start.alias("start"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "n", "start", F.col("role").isin(*trained).alias("trained"), F.concat("head", "body", F.lit(END)).alias("whole"),
        (F.col("start") + F.char_length("head")).alias("from"),
        (F.col("start") + F.char_length("head") + F.char_length("body")).alias("to"), "attached"))).alias("t"))
    mask = F.transform(F.filter("t", lambda t: t["trained"]), lambda t: F.struct(
        t["n"].alias("turn"), t["from"].alias("start"), t["to"].alias("end")))
    attached = F.flatten(F.col("t.attached"))
    return rows.select(
        "conv_id", F.array_join("t.whole", "").alias("formatted"), mask.alias("loss_mask"),
        F.col("t.start").alias("turn_starts"), attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column | str) -> Column:
    """array<struct<role, text>> read back from the formatted text; placeholders
    stay in the text."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        text = F.substring(piece, at + 1, F.char_length(piece) - at - len(END))
        return F.struct(unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column | str, mask: Column | str, turn_starts: Column | str) -> Column:
    """All text under the mask, unescaped, nothing between.  Each span is cut
    from its own turn, so the time is linear in the text."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    starts = F.col(turn_starts) if isinstance(turn_starts, str) else turn_starts

    def cut(m: Column) -> Column:
        begin = F.element_at(starts, (m["turn"] + 1).cast("int")) + len(START)
        return unescape(F.substring(F.element_at(pieces, (m["turn"] + 2).cast("int")),
                                    (m["start"] - begin + 1).cast("int"), (m["end"] - m["start"]).cast("int")))

    return F.array_join(F.transform(mask, cut), "")
