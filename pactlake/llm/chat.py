r"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

An event log has ``conv_id, seq, message, kind, role, text``; ``message``
numbers the messages of a conversation and ``kind`` is one of

* ``message``: the message is this text so far,
* ``delta``: the text is appended,
* ``edit``: the text replaces what the message said,
* ``regenerate``: the message starts anew and later messages, as far as the log
  has them by then, go.

:func:`fold` partitions the log by conversation, sorts it by ``seq`` and folds
it into final messages; :func:`render` writes them out as

    <|role|>ROLE<|text|>TEXT<|end|>        and, where the loss applies,
    <|role|>ROLE<|loss|>TEXT<|end|>

Inside roles and texts ``<\`` becomes ``<\\`` and then ``<|`` becomes ``<\|``, so a
control string never occurs in them, and the reverse steps restore them.
:func:`read_back` parses rendered conversations.

Edge cases: null texts and roles count as empty; a null ``conv_id`` is a
conversation of its own; events that share a ``seq`` go by message, role and
text; an unknown kind counts as ``message``; texts of any length are kept whole;
an empty log gives no rows; extra columns are ignored. A conversation is one
output row, so its rows meet in one task; everything up to that is computed per
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE, TEXT, LOSS, END = "<|role|>", "<|text|>", "<|loss|>", "<|end|>"


def escaped(x: Column) -> Column:
    once = F.replace(x, F.lit("<\\"), F.lit("<\\\\"))
    return F.replace(once, F.lit("<|"), F.lit("<\\|"))


def unescaped(x: Column) -> Column:
    once = F.replace(x, F.lit("<\\|"), F.lit("<|"))
    return F.replace(once, F.lit("<\\\\"), F.lit("<\\"))


def as_events(turns: DataFrame) -> DataFrame:
    """Rows by turn as the event log of a chat that ends with these turns.

    Every turn arrives as it would from a model or an editor: an even one as a
    draft, an edit to its first half and a delta with the rest; an odd one as a
    draft that the next message already answers, a regeneration, which takes
    both back, and two deltas.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(in_order).alias("message"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    draft = F.concat(F.lit("draft of "), "role")

    def event(number: int, kind: str, text: Column, later: int = 0) -> Column:
        return F.struct(
            (F.col("message") * 5 + number).cast("long").alias("seq"), (F.col("message") + later).cast("long").alias("message"),
            F.lit(kind).alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        )

    edited = F.array(event(0, "message", draft), event(1, "edit", head), event(2, "delta", tail))
    again = F.array(event(0, "message", draft), event(1, "message", draft, 1), event(2, "regenerate", F.lit("")), event(3, "delta", head), event(4, "delta", tail))
    events = F.when(F.col("message") % 2 == 0, edited).otherwise(again)
    return rows.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.message", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, message, role, text``: the final messages."""
    order = ["seq", "message", "role", "text"]
    later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    within = Window.partitionBy("conv_id", "message").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    again = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    kept = events.select("conv_id", "seq", "message", "kind", "role", "text").withColumn("again", again)
    kept = kept.where(F.col("again").isNull() | (F.col("again") >= F.col("message")))
    resets = F.sum(F.when(F.col("kind").eqNullSafe("delta"), 0).otherwise(1)).over(within)
    kept = kept.withColumn("resets", F.coalesce(resets, F.lit(0))).where("resets = 0")
    parts = F.array_sort(F.collect_list(F.struct("seq", "role", F.coalesce("text", F.lit("")).alias("text"))))
    return kept.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", F.struct("seq", "role")), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans``; spans are start and length in code points."""
    lossy = F.col("role") == loss_role
    head = F.concat(F.lit(ROLE), escaped(F.col("role")), F.when(lossy, F.lit(LOSS)).otherwise(F.lit(TEXT)))
    body = escaped(F.col("text"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat("head", "body", F.lit(END))
    rows = messages.select("conv_id", "message", lossy.alias("lossy"), head.alias("head"), body.alias("body")).select(
        "conv_id", "message", "lossy", piece.alias("piece"),
        (F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length("head")).alias("start"),
        F.length("body").alias("length"),
    )
    items = F.array_sort(F.collect_list(F.struct("message", "piece", "lossy", "start", "length")))
    spans = F.transform(
        F.filter("items", lambda x: x["lossy"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))
    )
    return (
        rows.groupBy("conv_id").agg(items.alias("items"))
        .select("conv_id", F.size("items").cast("long").alias("n_turns"),
                F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds ``turns``: the roles, texts and loss marks that the formatted text says."""
    pieces = F.slice(F.split("formatted", r"<\|end\|>"), 1, F.size(F.split("formatted", r"<\|end\|>")) - 1)

    def parse(piece: Column) -> Column:
        lossy = F.contains(piece, F.lit(LOSS))
        mark = F.when(lossy, F.lit(LOSS)).otherwise(F.lit(TEXT))
        parts = F.split(piece, r"<\|(?:text|loss)\|>", 2)
        return F.struct(
            unescaped(F.substring(parts[0], len(ROLE) + 1, 1 << 30)).alias("role"), unescaped(parts[1]).alias("text"), (mark == LOSS).alias("loss")
        )

    return rendered.withColumn("turns", F.transform(pieces, parse))


def digests(parsed: DataFrame) -> DataFrame:
    """The contract's figures, from what :func:`read_back` found."""
    says = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(says, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
