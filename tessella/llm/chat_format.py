"""Chat formatting with Spark expressions only, and the inverse.

Template of a conversation: for each run of adjacent turns of one role, one block

    <s>[INST]role[/INST]text[SEP]text...</s>

Control strings inside roles and texts are escaped: a backslash goes in after the opening
bracket, and one more where backslashes stand there already, so that taking one away is the
exact inverse. An escaped text therefore never holds a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template and the escape patterns over them.
BEGIN, END, OPEN, CLOSE, NEXT = "<s>", "</s>", "[INST]", "[/INST]", "[SEP]"
_PLAIN = r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\]|SEP\])"
_ESCAPED = r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\]|SEP\])"

#: Turns that are summed up together for the places of the texts.
_STEP = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit(r"$1$4\\$2$5$3$6"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit(r"$1$4$2$5$3$6"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<block, start, length>>.

    Turns are collected per conversation as structs and sorted by (turn, role, text). Where a run of
    one role begins is marked by the neighbour's role, and each run is a slice of the array that is
    joined, so that no array is copied turn by turn. A loss span names a stretch of code
    points of block number `block` (blocks are what lies between the END marks), counted from 0.

    Null role or text counts as empty; null turns come first; rows with a null conversation id
    form one conversation; ties keep the order (role, text), repeated rows stay. An empty table
    gives no rows; other columns are ignored. A conversation is one output string, so its size
    is bounded by what a row may hold.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    packed = turns.groupBy(F.col(conv_col).alias("_conv")).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")))).alias("turns"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    at = packed.withColumns({"n": F.size("turns"), "roles": F.transform("turns", lambda t: t["role"]), "texts": F.transform("turns", lambda t: escape(t["text"]))})
    at = at.withColumns({"wide": F.transform("texts", lambda t: F.length(t) + len(NEXT)), "starts": F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (F.get("roles", i - 1) != F.get("roles", i - 2)))})
    # What stands before each text, summed up in two levels: whole steps, then within the step.
    at = at.withColumn("steps", F.transform(F.sequence(F.lit(0), ((F.col("n") - 1) / _STEP).cast("int")), lambda j: total(F.slice("wide", j * _STEP + 1, _STEP))))
    at = at.withColumn("past", F.transform("steps", lambda x, j: total(F.slice("steps", F.lit(1), j))))
    # Named twice, so that the optimizer doesn't move the array's making into the lambda.
    whole = lambda i: F.when(F.get("past", (i / _STEP).cast("int")) > 0, F.get("past", (i / _STEP).cast("int"))).otherwise(0)
    at = at.withColumn("before", F.transform("wide", lambda x, i: whole(i) + total(F.slice("wide", i - i % _STEP + 1, i % _STEP))))
    run = lambda s, k: F.struct(F.get("roles", s - 1).alias("role"), s.alias("first"), (F.coalesce(F.get("starts", k + 1), F.col("n") + 1) - s).alias("many"))
    blocks = at.withColumn("blocks", F.transform("starts", run))
    head = lambda b: F.concat(F.lit(BEGIN + OPEN), escape(b["role"]), F.lit(CLOSE))
    body = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(F.slice("texts", b["first"], b["many"]), NEXT), F.lit(END)))

    def spans(block: Column, number: Column) -> Column:
        turn = lambda i: F.struct(number.alias("block"), (F.length(head(block)) + F.get("before", i - 1) - F.get("before", block["first"] - 1)).alias("start"), F.length(F.get("texts", i - 1)).alias("length"))
        every = F.transform(F.sequence(block["first"], block["first"] + block["many"] - 1), turn)
        return F.when(block["role"].isin(*loss_roles), every).otherwise(F.array().cast("array<struct<block:int,start:int,length:int>>"))

    return blocks.select(F.col("_conv").alias(conv_col), F.concat_ws("", body).alias("formatted"), F.flatten(F.transform("blocks", spans)).alias("loss_spans"))


def _blocks(formatted: Column) -> Column:
    parts = F.split(formatted, F.lit(r"\Q" + END + r"\E"), -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The inverse of format_chats, from its output alone: adds turns array<struct<role, text>> and loss_texts array<string>."""
    cut = formatted.withColumn("_blocks", _blocks(F.col("formatted")))
    close = F.lit(CLOSE)

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len(BEGIN + OPEN) + 1, F.length(block)), CLOSE, 1))
        texts = F.split(F.substring(block, F.instr(block, close) + len(CLOSE), F.length(block)), F.lit(r"\Q" + NEXT + r"\E"), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.element_at("_blocks", s["block"] + 1), s["start"] + 1, s["length"])))
    return cut.withColumns({"turns": F.flatten(F.transform("_blocks", turns)), "loss_texts": under}).drop("_blocks")


def digest_chats(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    read = parse_chats(formatted)
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss_texts")
    return read.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
