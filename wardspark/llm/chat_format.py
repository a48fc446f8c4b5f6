"""Chat formatting of typed content parts.

A turn is a list of parts. A text part is escaped; an image, audio or document part becomes as
many placeholders as it has tokens, and is recorded with its reference and place. Turns are
marked ``<|turn|>role\\n`` ... ``<|end|>\\n``.

Escaping: ``<``, ``[`` and ``\\`` get a backslash behind them, so no control string survives inside a
text, and one substitution takes the escapes out again. In roles a line feed becomes ``[n``.

A null text or role is empty, a null turn number comes first, a null conversation id is a
conversation of its own. Equal turn numbers are ordered by role and text. A formatted conversation is
one row; its size bounds the memory that a group needs, and a very long text must fit in it. An attachment of unknown
size has one token, one of very many is written as one placeholder with their number (``<|image*90000|>``). An empty
table gives an empty one; columns beside those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
# Tokens of a part: by pixels of a patch, seconds of a frame, pages.
PATCH, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 256
# Longer recordings, and those of no number of seconds, count as of unknown length.
MOST_SECONDS = 1e9
# A part of more tokens is written as one placeholder with their number.
MOST_PLACEHOLDERS = 1 << 16
MEDIA = ["image", "audio", "document"]
PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,"
        "pages:int>")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("[n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("[n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """The content of a turn that is nothing but a text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"),
                            *[F.lit(None).cast(t).alias(n) for n, t in (
                                ("ref", "string"), ("width", "int"), ("height", "int"),
                                ("seconds", "double"), ("pages", "int"))]))


def tokens_of(part: Column) -> Column:
    """Expanded tokens of a part; 0 for a text, at least 1 for an attachment."""
    def whole(x):
        return F.greatest(F.coalesce(x.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))

    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    frames = F.when(F.abs(part["seconds"]) < MOST_SECONDS, F.ceil(part["seconds"] * FRAMES_PER_SECOND))
    return (F.when(part["type"] == "image", whole(patches))
            .when(part["type"] == "audio", whole(frames))
            .when(part["type"] == "document", whole(part["pages"].cast("long") * TOKENS_PER_PAGE))
            .otherwise(F.lit(0).cast("long")))


def _shown(part: Column) -> Column:
    mark = F.concat(F.lit("<|"), part["type"], F.lit("|>"))
    counted = F.concat(F.lit("<|"), part["type"], F.lit("*"), tokens_of(part).cast("string"), F.lit("|>"))
    placeholders = F.when(tokens_of(part) <= MOST_PLACEHOLDERS, F.repeat(
        mark, F.least(tokens_of(part), F.lit(MOST_PLACEHOLDERS)).cast("int"))).otherwise(counted)
    return (F.when(part["type"].isin(MEDIA), placeholders)
            .otherwise(escaped(part["text"])))


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, body, media``: each turn's formatted parts, without markers.

    ``turns`` has ``conv_id, turn, role, content``, content an array of ``PART``. Every row is
    formatted on its own.
    """
    media = F.transform(
        F.filter(F.col("content"), lambda p: p["type"].isin(MEDIA)),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"),
                           tokens_of(p).alias("tokens")))
    body = F.array_join(F.transform("content", _shown), "")
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce(body, F.lit("")).alias("body"), media.alias("media"))


def format_conversations(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """``conv_id, formatted, mask, attachments``.

    ``mask`` lists ``(start, len)``, in code points of ``formatted``, of the bodies of
    the learned role. ``attachments`` lists ``(turn_index, type, ref, tokens)`` in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "body", "media")))
    grouped = format_turns(turns).groupBy("conv_id").agg(ordered.alias("turns"))
    segments = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escaped_role(t["role"]), F.lit("\n")).alias("head"),
        t["body"].alias("body"), t["role"].alias("role"), t["media"].alias("media")))
    built = grouped.select("conv_id", segments.alias("s"))
    zero = F.struct(F.lit(0).alias("at"),
                    F.array().cast("array<struct<start:int,len:int>>").alias("mask"))

    def step(state, seg):
        start = state["at"] + F.length(seg["head"])
        own = F.array(F.struct(start.alias("start"), F.length(seg["body"]).alias("len")))
        return F.struct((start + F.length(seg["body"]) + len(END)).alias("at"),
                        F.when(seg["role"] == learned, F.concat(state["mask"], own))
                        .otherwise(state["mask"]).alias("mask"))

    attachments = F.flatten(F.transform("s", lambda seg, i: F.transform(
        seg["media"], lambda m: F.struct(i.alias("turn_index"), m["type"].alias("type"),
                                         m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    return built.select(
        "conv_id",
        F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
        .alias("formatted"),
        F.aggregate("s", zero, step, lambda state: state["mask"]).alias("mask"),
        attachments.alias("attachments"))


def parse(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, learned_text, formatted, mask, attachments`` from the output alone:
    ``turns`` lists ``(role, text)``, ``learned_text`` all text under the mask. Attachments stay as
    placeholders in the text."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda x: x != "")
    turns = F.transform(pieces, lambda x: F.struct(
        unescaped_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescaped(F.regexp_replace(F.regexp_replace(x, r"\A[^\n]*\n", ""), r"<\|end\|>\n\z", ""))
        .alias("text")))
    learned = F.array_join(F.transform("mask", lambda m: unescaped(
        F.substring(F.col("formatted"), m["start"] + 1, m["len"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("learned_text"),
                            "formatted", "mask", "attachments")
