"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: the turns before it are its
context and only its reply is trainable. The examples of a conversation share
their prefix, so the formatted conversation is stored once, in pieces (one a
turn, with its place), and an example is a span of it: text up to the end of
the reply, loss on the reply alone. That keeps the output as long as the input
where writing every context out grows with the square of the turns;
``whole_examples`` writes them out for those who want them so.

The template marks a turn as ``<|turn|>role``, a line feed, the text and
``<|end|>``. Control strings inside roles and texts are broken by an inserted
escape, which reading removes, so every text comes back as it was.

Only DataFrame functions are used. A conversation's turns are summed in runs
of ``RUN`` turns and the runs are then put after one another, so a long
conversation is not one task's work.

Defined cases: null roles and texts are empty; an empty reply is an example
with nothing to train; turns after the last reply belong to no example; turns
with equal numbers (null is before all) follow each other by role, then text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings that chat templates use as marks.
CONTROL = ["<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
           "<|system|>", "<|user|>", "<|assistant|>", "<unk>", "<pad>"]
_BROKEN = "(?=" + "|".join(r"\Q" + c + r"\E" for c in CONTROL) + ")(.)"
RUN = 256
REPLY = "assistant"


def escape(text: Column) -> Column:
    r"""``\`` is doubled and every control string gets ``\-`` after its first character."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _BROKEN, r"$1\\-")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|-)", "$1")


def escape_role(role: Column) -> Column:
    r"""As in a text, and a line feed is ``\n``, since the role's line ends with one."""
    return F.regexp_replace(escape(role), "\n", r"\\n")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def formatted_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn, in its place in the formatted conversation.

    ``conv_id``, ``place`` (0, 1, ...), ``piece`` (the formatted turn),
    ``start`` (characters of the conversation before it), ``loss_start`` and
    ``loss_chars`` (the trainable span within the conversation; null and 0 but
    for replies), ``example`` (the number of the reply that this turn leads to
    or is; null after the last one).
    """
    clean_role, clean_text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    marked = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), clean_role.alias("role"), escape(clean_text).alias("body"),
        F.concat(F.lit(OPEN), escape_role(clean_role), F.lit("\n")).alias("head")).withColumn("run", F.floor(F.col("turn") / RUN))
    marked = marked.withColumn("chars", F.length("head") + F.length("body") + len(CLOSE)).withColumn("reply", (F.col("role") == REPLY).cast("long"))
    order = W.partitionBy("conv_id", "run").orderBy("turn", "role", "body")
    inside = order.rowsBetween(W.unboundedPreceding, -1)
    sums = {"chars": "start", "reply": "example", "one": "place"}
    local = marked.withColumn("one", F.lit(1).cast("long")).select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"own_{n}") for c, n in sums.items()])
    runs = marked.groupBy("conv_id", "run").agg(F.sum("chars").alias("chars"), F.sum("reply").alias("reply"), F.count("*").alias("one"))
    earlier = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    shifts = runs.select(
        F.col("conv_id").alias("c"), F.col("run").alias("r"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"shift_{n}") for c, n in sums.items()],
        F.sum("reply").over(W.partitionBy("conv_id")).alias("replies"))
    placed = local.join(shifts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("run").eqNullSafe(F.col("r")))
    start, example = (F.col(f"own_{n}") + F.col(f"shift_{n}") for n in ("start", "example"))
    is_reply = F.col("reply") == 1
    return placed.select(
        "conv_id", (F.col("own_place") + F.col("shift_place")).alias("place"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), start.alias("start"),
        F.when(is_reply, start + F.length("head")).alias("loss_start"), F.when(is_reply, F.length("body")).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
        F.when(example < F.col("replies"), example).alias("example"))


def _span() -> Column:
    """A reply's example in the formatted conversation; null for other turns."""
    return F.when(F.col("loss_start").isNotNull(), F.struct(
        "example", F.col("start").alias("context_chars"), (F.col("start") + F.length("piece")).alias("example_chars"), "loss_start", "loss_chars"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row a reply: its example's span (``context_chars``, ``example_chars``) and loss span in the formatted conversation."""
    return formatted.filter("loss_start IS NOT NULL").select("conv_id", _span().alias("span")).select("conv_id", "span.*")


def whole_conversations(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``: the pieces of each conversation put together; ``examples``: the spans of its replies' examples in order."""
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return formatted.groupBy("conv_id").agg(
        F.concat_ws("", F.transform(pieces, lambda x: x["piece"])).alias("formatted"), F.array_sort(F.collect_list(_span())).alias("examples"))


def example_text(formatted: Column, example: Column) -> Column:
    """An example written out: its context and its reply, up to the reply's end."""
    return F.substr(formatted, F.lit(1), example["example_chars"].cast("int"))


def example_target(text: Column, example: Column) -> Column:
    """The trainable part of a written-out example, unescaped."""
    return unescape(F.substr(text, (example["loss_start"] + 1).cast("int"), example["loss_chars"].cast("int")))


def whole_examples(formatted: DataFrame) -> DataFrame:
    """Every example written out: ``conv_id``, ``example``, ``text``, ``loss_start``, ``loss_chars``. Long as the square of a conversation's turns."""
    spans = whole_conversations(formatted).select("conv_id", "formatted", F.explode("examples").alias("x"))
    return spans.select("conv_id", "x.example", example_text(F.col("formatted"), F.col("x")).alias("text"), "x.loss_start", "x.loss_chars")


def read_turns(formatted: Column) -> Column:
    """The turns (``role``, ``text``) of a formatted conversation, unescaped."""
    marked = F.filter(F.split(formatted, r"\Q" + CLOSE + r"\E"), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(OPEN) + 1))
    return F.transform(marked, lambda x: F.struct(
        unescape_role(F.substring_index(body(x), "\n", 1)).alias("role"),
        unescape(F.substr(body(x), F.locate("\n", body(x)) + 1)).alias("text")))
