"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. The parser splits at the start mark,
takes the role up to the first newline and the text up to the first end mark, accepts nothing before, after or between
the turns and no ``<|`` inside a role or text, and removes one backslash from each ``<\\...|``. So a text is rendered
with one backslash more between each ``<`` and ``|`` (and none of the marks left), which the parser undoes; a role is
escaped too where its turn does not parse back to itself without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_out(role: Column) -> Column:
    """A role on one line: backslashes and line feeds escaped."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def role_in(role: Column) -> Column:
    """Undoes :func:`role_out`; NUL stands for an escaped backslash meanwhile, as text pairs are read from the left."""
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def parsed(formatted: Column) -> Column:
    """``array<struct<role, text>>`` from rendered turns; null if they are not of the grammar."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring_index(F.substring(part, F.length(role) + 2, F.length(part)), END.strip(), 1)
        whole = (part == F.concat(role, F.lit("\n"), text, F.lit(END))) & ~F.contains(role, F.lit("<|")) & ~F.contains(text, F.lit("<|"))
        return F.when(whole, F.struct(role_in(unescaped(role)).alias("role"), unescaped(text).alias("text")))

    parts = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)
    return F.when((F.get(parts, F.lit(0)) == "") & F.forall(turns, lambda t: t.isNotNull()), turns)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` from rows ``conv_id, turn, role, text``.

    ``loss_spans`` (start and end in code points, end exclusive) cover the rendered text of each ``loss_role`` turn.
    Null role or text counts as empty, a null conv_id is a conversation of its own; turns are ordered by turn, then
    role and text, nulls first; repeated rows are repeated turns; other columns are not read. A turn that no rendering
    brings back raises an error. An empty table gives an empty result.
    """
    source = turns.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain, safe = rendered(F.col("role"), escaped(F.col("text"))), rendered(escaped(role_out(F.col("role"))), escaped(F.col("text")))
    same = lambda shown: F.coalesce(parsed(shown) == F.array(F.struct("role", "text")), F.lit(False))
    shown = F.when(same(plain), plain).when(same(safe), safe).otherwise(F.raise_error(F.lit("a turn does not survive its round trip")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = source.withColumn("shown", shown).withColumn("n", F.length("shown"))
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).withColumn("stop", F.sum("n").over(order))
    head = F.length(F.substring_index("shown", "\n", 1)) + 1
    span = F.struct((F.col("stop") - F.col("n") + head).alias("start"), (F.col("stop") - len(END)).alias("end"))
    item = F.struct("nth", "shown", F.when(F.col("role") == loss_role, span).alias("span"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss_spans"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the rendered text alone says: turns, their digest, and the text under the loss mask. Raises an error for text not of the grammar."""
    turns = formatted.withColumn("turns", F.coalesce(parsed(F.col("formatted")), F.raise_error(F.lit("a conversation is not of the grammar"))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    loss = F.array_join(masked, "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
