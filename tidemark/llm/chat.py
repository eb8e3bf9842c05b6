"""Chat formatting: conversations to training texts with a loss mask, and back.

The template. A run of adjacent turns of one role is one block::

    <|im_start|>role \\n text [<|im_part|> text ...] <|im_end|> \\n

``<|im_part|>`` stands between the texts of turns that were merged. Inside roles and texts every ``<``,
any number of backslashes, ``|`` gets one backslash more, so no control string occurs inside a text and
taking one backslash away restores it. A line feed inside a role is written ``<|im_nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END, LINE = "<|im_start|>", "<|im_part|>", "<|im_end|>", "<|im_nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def format_chat(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``n_blocks``, ``formatted``, ``loss_spans``.

    ``loss_spans`` holds (start, chars) of each text of ``loss_role`` within ``formatted``, in code points
    from 0; the rest of the text carries no loss.

    Turns are sorted by turn, then role, then text, so ties and repeated rows have a fixed order and all
    are kept; a null turn comes first. Null roles and texts count as empty strings; rows whose id is null
    form one conversation. Other columns are ignored. An empty table gives an empty result.

    Scale: one shuffle, by conversation. A conversation is one output value, so its turns meet in one
    task by necessity; escaping runs before the shuffle.
    """
    rows = conversations.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.regexp_replace(escape(F.col(role_col)), "\n", LINE).alias("role"),
            escape(F.col(text_col)).alias("text"),
            F.coalesce(F.col(role_col) == loss_role, F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    turns = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    # Places where a block starts, then each block as a slice of the turns.
    place = F.sequence(F.lit(0), F.size("turns") - 1)
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    starts = turns.withColumn("starts", F.filter(place, lambda i: (i == 0) | (role_at(i) != role_at(i - 1))))
    upto = lambda j: F.coalesce(F.get(F.col("starts"), j + 1), F.size("turns"))
    blocks = starts.withColumn("blocks", F.transform("starts", lambda s, j: F.slice("turns", s + 1, upto(j) - s)))

    def written(block: Column) -> Column:
        texts = F.array_join(F.transform(block, lambda t: t["text"]), PART)
        return F.concat(F.lit(START), F.get(block, F.lit(0))["role"], F.lit("\n"), texts, F.lit(END + "\n"))

    # Lengths before, of and after each text; a running sum of them places the spans.
    def lengths(block: Column) -> Column:
        head = F.length(F.get(block, F.lit(0))["role"]) + len(START) + 1
        return F.transform(
            block,
            lambda t, i: F.struct(
                F.when(i == 0, head).otherwise(len(PART)).cast("long").alias("before"),
                F.length(t["text"]).cast("long").alias("own"),
                F.when(i == F.size(block) - 1, len(END) + 1).otherwise(0).cast("long").alias("after"),
                t["loss"].alias("loss"),
            ),
        )

    spans = "array<struct<start:bigint,chars:bigint>>"

    def place_span(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["before"]
        span = F.array(F.struct(at.alias("start"), x["own"].alias("chars")))
        return F.struct((at + x["own"] + x["after"]).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("spans"))
    return blocks.select(
        F.col("id").alias(id_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("blocks", written), "").alias("formatted"),
        F.aggregate(F.flatten(F.transform("blocks", lengths)), start, place_span)["spans"].alias("loss_spans"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Reads the output of :func:`format_chat` back: adds ``turns_back`` (role, text) and ``loss_text``.

    Uses nothing but ``formatted`` and ``loss_spans``.
    """
    block_texts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape(F.replace(head, F.lit(LINE), F.lit("\n")))
        body = F.substring(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_part\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))))
    return formatted.withColumns({"turns_back": F.flatten(F.transform(block_texts, turns)), "loss_text": F.array_join(loss, "")})


def chat_digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the output holds, as counts and digests."""
    lines = F.transform("turns_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_chat(formatted).select(
        id_col,
        F.size("turns_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
