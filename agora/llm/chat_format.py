"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are
context, only its reply is trainable. A turn reads ``<turn ROLE>TEXT</turn>``
and a line feed. Inside roles and texts a backslash becomes ``\\b`` and ``<``
becomes ``\\l`` (in roles also ``>`` becomes ``\\g``), so that no text can
hold a mark and every example reads back exactly.

Turns behind the last assistant turn, and conversations without one, come as
a last example without a trainable part, so that no turn is lost.

A conversation is one context, so its turns meet in one row. The examples of
n turns hold about n * n / 2 turns, as prefix-target expansion means.

Defined results: a null role or text is empty. Turns are ordered by turn,
role and text, null turns first, and rows that repeat stay. A null conv_id is
a conversation of its own. Extra columns are ignored; an empty table gives no
examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def turn_head(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.replace(escaped(role), F.lit(">"), F.lit("\\g")), F.lit(">"))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length): offsets and lengths in code points."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct(
        F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    marked = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("reply"), turn_head(t["role"]).alias("head"),
        escaped(t["text"]).alias("body"))).alias("turns"))
    last = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), last), lambda k: F.get("turns", k - 1)["reply"] | (k == last))
    examples = marked.select("conv_id", "turns", F.posexplode(targets).alias("example", "target"))
    target = F.get("turns", F.col("target") - 1)
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("target") - 1),
                                       lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "")
    parts = examples.select("conv_id", "example", context.alias("context"), target.alias("target"))
    return parts.select(
        "conv_id", "example",
        F.concat("context", "target.head", "target.body", F.lit(TURN_END)).alias("text"),
        (F.length("context") + F.length("target.head")).cast("long").alias("loss_start"),
        F.when(F.col("target.reply"), F.length("target.body")).otherwise(0).cast("long").alias("loss_length"))


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted example."""
    pieces = F.split(text, TURN_END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescaped(F.substr(F.substring_index(p, ">", 1), F.lit(7))).alias("role"),
        unescaped(F.substr(p, F.length(F.substring_index(p, ">", 1)) + 2)).alias("text")))


def read_loss(text: Column, start: Column, length: Column) -> Column:
    """The trainable text of a formatted example."""
    return unescaped(F.substr(text, (start + 1).cast("int"), length.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text and their hashes."""
    read = examples.select("conv_id", "example", "text",
                           read_loss(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"))
    turns = whole.withColumn("turns", read_turns(F.col("last")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                        "formatted_chars")
