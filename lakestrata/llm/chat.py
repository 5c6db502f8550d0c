"""Chat formatting with Spark expressions only.

Turns of a conversation are sorted structs. Adjacent turns of one role share a block::

    <|im_start|>ROLE
    TEXT<|im_sep|>TEXT<|im_end|>

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a
control string, and both changes are undone in the opposite order. A line break inside a role is
written ``<\\/``. The separator keeps merged turns apart, so reading back gives every turn as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and ``loss``, an array of (start, length) spans.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. A null role or text is empty, a
    null turn sorts first, and equal turn numbers are ordered by role and text; repeated rows are
    repeated turns. Rows with a null conv_id form one conversation. No rows give no conversations. Spans
    count code points from 1 and cover the escaped texts of the role ``learn``, one span per turn.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    chats = chats.select(
        "conv_id",
        F.transform("said", lambda s: s["role"]).alias("roles"),
        F.transform("said", lambda s: escape(s["text"])).alias("texts"),
    )
    # Places, from 1, at which a block begins.
    first = F.filter(F.sequence(F.lit(1), F.size("roles")), lambda i: (i == 1) | (F.get("roles", i - 1) != F.get("roles", i - 2)))
    chats = chats.withColumn("first", first)

    def block(start: Column, k: Column) -> Column:
        after = F.coalesce(F.get("first", k + 1), F.size("roles") + 1)
        body = F.array_join(F.slice("texts", start, after - start), SEP)
        return F.concat(F.lit(START), escape_role(F.get("roles", start - 1)), F.lit("\n"), body, F.lit(END + "\n"))

    # What stands before and after a text, and where texts begin: a running total over the turns.
    def step(state: Column, i: Column) -> Column:
        opens = F.array_contains("first", i)
        head = F.when(opens, F.length(escape_role(F.get("roles", i - 1))) + len(START) + 1).otherwise(len(SEP))
        tail = F.when(opens & (i > 1), len(END) + 1).otherwise(0)
        begin = state["at"] + tail + head
        size = F.length(F.get("texts", i - 1))
        span = F.struct(begin.cast("int").alias("start"), size.cast("int").alias("length"))
        spans = F.when(F.get("roles", i - 1) == learn, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((begin + size).cast("int").alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,length:int>>")
    zero = F.struct(F.lit(1).alias("at"), none.alias("spans"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("first", block), "").alias("formatted"),
        F.aggregate(F.sequence(F.lit(1), F.size("roles")), zero, step)["spans"].alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        role = unescape_role(F.substring_index(F.replace(b, F.lit(START), F.lit("")), "\n", 1))
        body = F.substring(b, F.instr(b, "\n") + 1, F.length(b))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
