"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all preceding turns are its context and only its
reply is under the loss mask. ``expand`` writes the examples out, each with its whole context. A
conversation of n turns has contexts of O(n^2) characters in all, so nothing but a conversation's
stream is shuffled or stored on the way: the examples are cut from it where it lies, one at a time.
``examples`` gives them as spans of that stream instead, for trainers that read spans.

Template, per turn: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Inside roles and texts a
backslash is doubled, and one is put behind the first character of any control string: ``<|``,
``<s>``, ``</s>``, ``[INST]``, ``[/INST]``. ``unescape`` undoes this exactly.

Defined results: a null role or text is empty; rows of a conversation are ordered by turn (nulls
first), then role, then text, and repeated rows are turns of their own; a null conv_id is a
conversation; a conversation without assistant turns has no example; an empty table gives none.
Columns other than the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_TAIL = r"(?=\||s>|/s>|INST\]|/INST\])"


def escape(col: Column) -> Column:
    doubled = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<|\[)" + _TAIL, r"$1\\")


def unescape(col: Column) -> Column:
    opened = F.regexp_replace(col, r"(<|\[)\\" + _TAIL, "$1")
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def segments(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, seq (from 0), role, segment (rendered), start and stop in the
    conversation's stream, text_start and text_stop of its text there (code points)."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("head_chars", F.length(head).cast("long")).withColumn(
        "segment", F.concat(head, escape(F.col("text")), F.lit(END))
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    chars = F.length("segment").cast("long")
    rows = rows.withColumn("seq", F.row_number().over(order).cast("long") - 1).withColumn(
        "stop", F.sum(chars).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    start = F.col("stop") - chars
    return rows.select(
        "conv_id", "seq", "role", "segment", start.alias("start"), "stop",
        (start + F.col("head_chars")).alias("text_start"), (F.col("stop") - len(END)).alias("text_stop"),
    )


def streams(turns: DataFrame) -> DataFrame:
    """One row per conversation: its formatted text and the spans of its turns there (seq, role, start, stop, text_start, text_stop)."""
    spans = F.struct("seq", "role", "start", "stop", "text_start", "text_stop")
    held = F.sort_array(F.collect_list(F.struct("seq", "segment", spans.alias("span"))))
    return turns.groupBy("conv_id").agg(held.alias("held")).select(
        "conv_id", F.array_join(F.col("held.segment"), "").alias("formatted"), F.col("held.span").alias("spans")
    )


def expand(formatted: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """The rows of ``streams``, one for each trainable turn (one with nulls where there is none): the other columns but formatted
    and spans, example (from 0), n_context_turns, context (all before the reply), target (the rendered reply), loss_start and loss_stop (the mask, in context and target)."""
    wanted = F.filter("spans", lambda x: x["role"] == trainable_role)
    others = [c for c in formatted.columns if c not in ("formatted", "spans")]
    rows = formatted.select(*others, "formatted", F.posexplode_outer(wanted).alias("example", "span"))
    start, stop = F.col("span.start").cast("int"), F.col("span.stop").cast("int")
    return rows.select(
        *others, F.col("example").cast("long").alias("example"), F.col("span.seq").alias("n_context_turns"), F.left("formatted", start).alias("context"),
        F.substring("formatted", start + 1, stop - start).alias("target"), F.col("span.text_start").alias("loss_start"), F.col("span.text_stop").alias("loss_stop"),
    )


def examples(turns: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """One row per trainable turn: conv_id, example (from 0), n_context_turns, context_chars (the
    context is that prefix of the stream), target (the rendered reply), loss_start and loss_stop (the
    mask, in the stream's code points)."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")).cast("long") - 1
    return turns.filter(F.col("role") == trainable_role).select(
        "conv_id", number.alias("example"), F.col("seq").alias("n_context_turns"), F.col("start").alias("context_chars"),
        F.col("segment").alias("target"), F.col("text_start").alias("loss_start"), F.col("text_stop").alias("loss_stop"),
    )


def read_turns(formatted: Column) -> Column:
    """A stream back as an array of (role, text)."""
    parts = F.split(formatted, r"<\|turn\|>", -1)
    inner = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda x: F.split(F.regexp_replace(x, r"<\|end\|>$", ""), r"<\|text\|>", 2),
    )
    return F.transform(inner, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def loss_text(whole: Column) -> Column:
    """What the mask of an example (``whole``: its context and target) covers, unescaped."""
    return unescape(F.substring(whole, (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int")))


def read_back(turns: DataFrame) -> DataFrame:
    """Digests per conversation of what the formatted streams and the examples, written out with their contexts, hold."""
    formatted = streams(turns).withColumn("turns", read_turns(F.col("formatted")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    formatted = formatted.select(
        "conv_id", "formatted", "spans", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    made = expand(formatted).withColumn("whole", F.concat("context", "target"))
    made = made.select(
        "conv_id", "n_turns", "turns_sha256", "formatted_chars", "example", loss_text(F.col("whole")).alias("loss"),
        F.sha2("whole", 256).alias("digest"), F.length("whole").cast("long").alias("chars"),
    )
    per_example = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "loss", "digest"))))
    found = made.groupBy("conv_id").agg(
        F.first("n_turns").alias("n_turns"), F.first("turns_sha256").alias("turns_sha256"), F.first("formatted_chars").alias("formatted_chars"),
        F.count("example").alias("n_examples"), F.coalesce(F.sum("chars"), F.lit(0).cast("long")).alias("expanded_chars"), per_example.alias("made"),
    )
    loss = F.array_join(F.col("made.loss"), "")
    return found.select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
        "n_examples", "expanded_chars", F.sha2(F.array_join(F.col("made.digest"), ""), 256).alias("examples_sha256"),
    )
