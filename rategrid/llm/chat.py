"""Chat formatting: budgeted, turn-aligned windows over conversations with a loss mask.

Everything here is DataFrame expressions; no Python runs on the executors.

Template.  A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a backslash becomes two, and a
backslash is put after the first character of every control string (``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``, ``<<SYS>>``, ``<</SYS>>``; in roles also before a line feed), so no control string survives inside a text and
``unescape`` gives back the original.

Windows.  With ``p`` the prefix sum of the token counts of the turns before a turn, the turn's targets belong to window
``p div stride``, where ``stride = budget - history``.  Only windows that own a turn exist.  A window consists of the system
turn (when the first turn's role is ``system``), then of the longest run of turns directly before its span whose tokens
do not exceed ``history``, then of its span.  Repeated turns are context: they are not under the loss mask.  A turn longer than
the budget stays whole.

Scale.  No row holds more than a window.  Turns are numbered and their tokens summed by window functions within buckets of ``BUCKET`` turn
numbers, after the sums of the buckets before; then each turn goes to the windows that it is in.  Only ``read_back``, and so the digests,
put a whole conversation into one row, as a digest runs over all its turns.

Edge cases.  Null texts and roles count as empty.  Rows with the same turn number are ordered by role and text; repeated rows are
turns of their own; null turn numbers come first.  Rows with a null ``conv_id`` form one conversation.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET = 512
HISTORY = 128
BUCKET = 1024  # turn numbers whose turns are numbered together
SYSTEM_WINDOWS = 64  # windows that share a copy of their conversation's system turn
OVERHEAD = 4  # tokens that the markers of a turn are counted as

START, END = "<|im_start|>", "<|im_end|>"
#: First characters of control strings, where a backslash is put in.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + F.lit(OVERHEAD)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_context (leading turns that are repeated), loss (array of
    start and length in code points, both within ``formatted``, of the texts the loss covers)."""
    if not 0 <= history < budget:
        raise ValueError("history must be at least 0 and below budget")
    stride = budget - history
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("size", tokens(F.col("text")).cast("long")).withColumn("bucket", F.floor(F.col("turn") / F.lit(BUCKET)))
    # number and tokens of the turns before: those of earlier buckets, and those before in the own one
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("conv_id", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sums = sums.select(
        F.col("conv_id").alias("_conv"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size0"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.sum("size").over(Window.partitionBy("conv_id")).alias("total"),
    )
    turns = turns.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("bucket").eqNullSafe(F.col("_bucket")))
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text")
    before = F.col("size0") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.select(
        "conv_id", "role", "total", (F.col("n0") + F.row_number().over(inside) - 1).cast("long").alias("i"), before.alias("before"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    # each turn goes to its own window and to those that it can be context of
    owner = F.floor(F.col("before") / F.lit(stride))
    parts = turns.withColumn("window", F.explode(F.sequence(owner, F.floor((F.col("before") + F.lit(history)) / F.lit(stride)))))
    parts = parts.withColumn("own", F.col("window") == owner)
    part = F.struct("i", "before", "own", "head", "body", (F.col("own") & (F.col("role") == "assistant")).alias("target"))
    spans = parts.groupBy("conv_id", "window").agg(F.min(F.when(F.col("own"), F.col("before"))).alias("start"), F.collect_list(part).alias("parts")).filter("start is not null")
    spans = spans.withColumn("parts", F.array_sort(F.filter("parts", lambda p: p["own"] | (p["before"] >= F.col("start") - F.lit(history)))))
    # the system turn, once for every SYSTEM_WINDOWS windows of its conversation
    system = turns.filter((F.col("i") == 0) & (F.col("role") == "system")).select(
        F.col("conv_id").alias("_conv"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / F.lit(stride * SYSTEM_WINDOWS)))).alias("_part"),
        F.struct("i", "before", F.lit(False).alias("own"), "head", "body", F.lit(False).alias("target")).alias("system"),
    )
    spans = spans.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.floor(F.col("window") / F.lit(SYSTEM_WINDOWS)) == F.col("_part")), "left")
    spans = spans.withColumn(
        "parts", F.when(F.col("system").isNotNull() & (F.col("parts")[0]["i"] > 0), F.concat(F.array("system"), "parts")).otherwise(F.col("parts"))
    )
    tail = F.lit(END + "\n")
    formatted = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], tail)))
    # offsets of the bodies: running sum of the lengths of the parts before, plus the head
    length = lambda p: F.length(p["head"]) + F.length(p["body"]) + F.length(tail)
    acc0 = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")
    )
    step = lambda acc, p: F.struct(
        (acc["at"] + length(p)).alias("at"),
        F.when(
            p["target"],
            F.concat(
                acc["loss"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")
                    )
                ),
            ),
        )
        .otherwise(acc["loss"])
        .alias("loss"),
    )
    return spans.select(
        "conv_id",
        "window",
        formatted.alias("formatted"),
        F.size(F.filter("parts", lambda p: ~p["own"])).alias("n_context"),
        F.aggregate("parts", acc0, step)["loss"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations that ``windows`` wrote, read from its output alone.

    One row per conversation: conv_id, turns (array of role and text, unescaped, each turn once, in order), loss_text,
    formatted_chars.
    """
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    own = F.slice(pieces, F.col("n_context") + 1, F.greatest(F.size(pieces) - F.col("n_context"), F.lit(0)))
    header = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$"
    turns = F.transform(
        own,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, header, 1)).alias("role"),
            unescape(F.regexp_extract(p, header, 2)).alias("text"),
        ),
    )
    loss = F.concat_ws(
        "",
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))),
    )
    per_window = formatted.select(
        "conv_id",
        F.struct("window", turns.alias("turns"), loss.alias("loss")).alias("w"),
        F.length("formatted").cast("long").alias("chars"),
    )
    per_conv = per_window.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars")
    )
    return per_conv.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.concat_ws("", F.transform("ws", lambda w: w["loss"])).alias("loss_text"),
        "formatted_chars",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``windows`` wrote, per conversation."""
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
