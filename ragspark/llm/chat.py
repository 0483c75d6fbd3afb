"""Chat formatting: one training example per assistant turn, with all preceding turns as context.

Template, for each turn: ``<|turn|>`` role newline text ``<|end|>`` newline.
Roles and texts are escaped so that no control string can occur inside them,
and the escape is reversible:

====  =======
raw   escaped
====  =======
``\\`` ``\\e``
``<`` ``\\l``
``[`` ``\\s``
====  =======

Only the target's escaped text is under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import bind

START, END = "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """Reversible escape: the backslash first, so that every later one is ours."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\s"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\s"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role is one line of the template, so its newlines are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (1-based), trainable, n_turns, formatted, loss_start, loss_chars.

    ``loss_start`` is the 0-based code point of the target's text in ``formatted``.
    Rows of one conversation are ordered by turn, ties by role and text; null
    turns come first; null roles and texts count as empty; repeated rows stay;
    a null conv_id is a conversation of its own. Turns after the last assistant
    turn form one more example with nothing to train on, so that no turn is
    lost. An empty table gives no rows; extra columns are ignored. The longest
    example of a conversation holds all of it, so a conversation fits in one row
    by the nature of the result.
    """
    role = F.coalesce("role", F.lit(""))
    piece = F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), piece.alias("piece"),
    )
    whole = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_turns"))
    whole = bind(whole, _pieces=F.transform("_turns", lambda t: t["piece"])).withColumn("_n", F.size("_pieces"))
    places = F.filter(
        F.transform("_turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)), lambda i: i > 0
    )
    whole = bind(whole, _at=places).drop("_turns")
    last = F.coalesce(F.array_max("_at"), F.lit(0))
    targets = F.concat("_at", F.when(last < F.col("_n"), F.array(F.col("_n"))).otherwise(F.array().cast("array<int>")))
    rows = whole.select(
        "conv_id", "_pieces", F.array_contains("_at", F.col("_n")).alias("_ends"), F.size("_at").alias("_answers"),
        F.posexplode(targets).alias("_k", "_turn"),
    )
    trainable = F.col("_k") < F.col("_answers")
    target = F.element_at("_pieces", F.col("_turn"))
    before = F.concat_ws("", F.slice("_pieces", 1, F.col("_turn") - 1))
    head = len(START) + len("assistant") + 1
    return rows.select(
        "conv_id", (F.col("_k") + 1).cast("long").alias("example"), trainable.alias("trainable"),
        F.col("_turn").cast("long").alias("n_turns"), F.concat(before, target).alias("formatted"),
        F.when(trainable, F.length(before) + head).otherwise(0).cast("long").alias("loss_start"),
        F.when(trainable, F.length(target) - head - len(END)).otherwise(0).cast("long").alias("loss_chars"),
    )


def parse(formatted: Column) -> Column:
    """Turns of a formatted example as an array of (role, text)."""
    pieces = F.array_remove(F.split(formatted, r"<\|turn\|>"), "")
    body = lambda p: F.substr(p, F.lit(1), F.length(p) - len(END))
    return F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(body(p), F.instr(p, "\n") + 1)).alias("text"),
    ))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: turns and text under the mask.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn),
    loss_chars and loss_sha256 (of the unescaped masked texts in order),
    formatted_chars (code points of all its examples).
    """
    # substr of a missing length would end early, so the mask is cut by its own columns.
    masked = F.when(F.col("trainable"), unescape(F.substr("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int"))))
    rows = formatted.select(
        "conv_id", "example", F.struct("n_turns", "formatted").alias("_whole"), F.length("formatted").alias("_size"), masked.alias("_loss")
    )
    one = rows.groupBy("conv_id").agg(
        F.max("_whole").alias("_whole"), F.sum("_size").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "_loss"))).alias("_losses"),
    )
    one = bind(one, _turns=parse(F.col("_whole.formatted")), _masked=F.concat_ws("", F.transform("_losses", lambda x: x["_loss"])))
    text = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return one.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("_masked").cast("long").alias("loss_chars"), F.sha2("_masked", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
