r"""Chat formatting of typed content parts, in DataFrame functions only.

A turn holds parts of the kinds text, image, audio and document. A visitor walks over them in order:
text is escaped and copied, an attachment leaves a placeholder and is recorded with its place, its
reference and the number of tokens it stands for. Turns become

    <|turn|>role<|body|>part<|part|>part<|end|>

Control strings inside texts and roles get a backslash after their first character, and one more if there
already are some, so a text can hold any of them and still be read back. The loss mask is a list
of stretches (start, length in code points) over the formatted string: the bodies of the assistant.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens for a unit of an attachment: image tiles, seconds of sound, pages.
UNIT_TOKENS = {"image": 256.0, "audio": 25.0, "document": 512.0}
#: What may not stand in a text as it is: this template's marks and those of common others.
_REST = r"(?:\|(?:turn|body|part|end|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\])"
PARTS_TYPE = "array<struct<kind:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_REST})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_REST})", "$1$2")


def text_parts(text: Column) -> Column:
    """A single text part; a null text is an empty one."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            none.cast("string").alias("ref"),
            none.cast("double").alias("units"),
        )
    )


def _visit(part: Column) -> Column:
    """What a part leaves in the body. Kinds that are not known are kept as text."""
    shown = escape(F.coalesce(part["text"], F.lit("")))
    for kind, placeholder in PLACEHOLDERS.items():
        shown = F.when(part["kind"] == kind, F.lit(placeholder)).otherwise(shown)
    return shown


def _tokens(part: Column, unit_tokens: Mapping[str, float]) -> Column:
    each = F.lit(0.0)
    for kind, rate in unit_tokens.items():
        each = F.when(part["kind"] == kind, F.lit(float(rate))).otherwise(each)
    return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * each).cast("long")


def format_chats(turns: DataFrame, unit_tokens: Mapping[str, float] = UNIT_TOKENS, learned_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans, attachments, attachment_tokens`` from ``conv_id, turn, role, parts``.

    Turns stand in order of ``turn`` (nulls first), then role and content, so repeated rows and ties are
    turns of their own in a fixed order. A null role is empty; null parts are a turn without a body.
    Attachments hold turn (from 0), part (from 0), kind, ref and tokens. Other columns are not read.
    A conversation is one row of the result; nothing else is gathered.
    """
    parts = F.coalesce("parts", F.array().cast(PARTS_TYPE))
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(BODY))
    seen = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role") == learned_role, F.lit(False)).alias("learned"),
        head.alias("head"),
        F.array_join(F.transform(parts, _visit), PART).alias("body"),
        F.filter(
            F.transform(
                parts,
                lambda part, i: F.struct(
                    i.alias("part"), part["kind"].alias("kind"), part["ref"].alias("ref"), _tokens(part, unit_tokens).alias("tokens")
                ),
            ),
            lambda part: part["kind"].isin(*PLACEHOLDERS),
        ).alias("found"),
    )
    segment = F.concat("head", "body", F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "head", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("number"),
        segment.alias("segment"),
        F.when(
            F.col("learned"),
            F.struct(
                (F.coalesce(F.sum(F.length(segment)).over(before), F.lit(0)) + F.length("head")).cast("long").alias("start"),
                F.length("body").cast("long").alias("length"),
            ),
        ).alias("span"),
        "found",
    )
    # Null spans are left out by collect_list; the start of a span is its order.
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "segment"))).alias("segments"),
        F.array_sort(F.collect_list("span")).alias("loss_spans"),
        F.array_sort(F.collect_list(F.when(F.size("found") > 0, F.struct("number", "found")))).alias("found"),
    )
    attachments = F.flatten(
        F.transform(
            "found",
            lambda turn: F.transform(
                turn["found"],
                lambda part: F.struct(
                    turn["number"].alias("turn"),
                    part["part"].alias("part"),
                    part["kind"].alias("kind"),
                    part["ref"].alias("ref"),
                    part["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("formatted"),
        "loss_spans",
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Turns read back from the formatted string: array of struct(role, bodies); a placeholder stays as it is."""
    pieces = F.split(formatted, F.lit(r"<\|turn\|>"))
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda piece: F.struct(
            unescape(F.substring_index(piece, BODY, 1)).alias("role"),
            F.transform(
                F.split(F.substring_index(F.substring_index(piece, BODY, -1), END, 1), F.lit(r"<\|part\|>")), unescape
            ).alias("bodies"),
        ),
    )


def learned_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digest(chats: DataFrame) -> DataFrame:
    """Checks of formatted chats, computed from the formatted string and its mask alone."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["bodies"], ""), F.lit("\n"))), ""
    )
    learned = F.array_join(learned_texts(F.col("formatted"), F.col("loss_spans")), "")
    return chats.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
