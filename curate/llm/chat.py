"""Chat formatting from an event log.

A log holds what happened to messages: ``start`` (gives the role), ``delta`` (text streamed on), ``edit`` (the text
becomes this), ``regenerate`` (what was streamed goes, new deltas follow) and ``delete``. The log is partitioned by
conversation and message, put in sequence and folded into final messages; these are rendered in order. DataFrame
functions only.

The template of a turn is ``### role:``, a line break, the text, ``</turn>`` and a line break. Inside roles and
texts the backslash and the two control strings are escaped, so any text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.functions.base import let

OPEN, CLOSE, HEAD = "### ", "</turn>\n", ":\n"
#: In this order when escaping, in reverse when reading. Afterwards each backslash begins one of these escapes.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("\n", "\\l"))
RESETS = ("start", "edit", "regenerate")
LOSS_ROLES = ("assistant",)
#: Code points of one delta when a finished table is replayed as a log.
DELTA = 512


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, lines: bool = False) -> Column:
    """Text without control strings; ``lines`` escapes line breaks too (for roles)."""
    for old, new in ESCAPES if lines else ESCAPES[:-1]:
        c = _replace(c, old, new)
    return c


def unescape(c: Column) -> Column:
    for old, new in reversed(ESCAPES):
        c = _replace(c, new, old)
    return c


def as_events(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """Replay a table of finished turns (conv_id, turn, role, text) as the log that led to it.

    A reply is streamed twice, the first try (its first half) being regenerated; any other message is first sent as a
    draft and then edited, if it is short, or streamed. Rows of one conversation and turn are several messages, by role
    and text.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", "role", text.alias("text"), nth.alias("nth"))
    n = F.length("text")
    long = (F.col("role") == "assistant") | (n > delta)
    half = F.substring(F.col("text"), F.lit(1), (n / 2).cast("int"))

    def event(kind: str, value: Column, role: Column | None = None) -> Column:
        role = F.lit(None).cast("string") if role is None else role
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), value.cast("string").alias("text"))

    starts = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / delta).cast("int"))
    parts = F.transform(starts, lambda i: event("delta", F.substring(F.col("text"), i * delta + 1, F.lit(delta))))
    draft = F.array(event("start", F.lit(None), F.col("role")), event("delta", half))
    streamed = F.concat(draft, F.array(event("regenerate", F.lit(None))), parts)
    edited = F.concat(draft, F.array(event("edit", F.col("text"))))
    events = F.posexplode(F.when(long, streamed).otherwise(edited))
    rows = rows.select("conv_id", F.struct("turn", "nth").alias("message"), events.alias("step", "e"))
    return rows.select("conv_id", "message", F.struct("message", "step").alias("seq"), "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the final messages of a log (conv_id, message, seq, kind, role, text).

    Events are put in order of ``seq`` (unique in a message), whatever order they arrived in. A message's text is what its last
    start, edit or regeneration and the deltas after it say; deltas before any of them count from the first event. NULL text
    is empty. The role is the one given last by an event that has one (none: empty). A message whose last event besides deltas
    is ``delete`` is dropped. Messages stand in order of their first event. NULL conversation ids are one conversation.
    """
    step = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(step)).alias("log"))
    reset = F.array_max(F.transform(F.filter("log", lambda e: e["kind"].isin(*RESETS, "delete")), lambda e: e["seq"]))
    rows = rows.withColumn("since", F.coalesce(reset, F.col("log")[0]["seq"]))
    rows = rows.withColumn("live", F.filter("log", lambda e: e["seq"] >= F.col("since")))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return rows.where(F.col("live")[0]["kind"] != "delete").select(
        "conv_id",
        F.col("log")[0]["seq"].alias("at"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform("live", lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, n_turns, formatted, loss): one row per conversation; ``loss`` are (start, length) spans in code points, and
    (byte_start, byte_length), the same in bytes.

    The mask covers the escaped texts of ``loss_roles`` and nothing of the template. A conversation is one string, so it
    must fit a row; messages are rendered before they are brought together.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), lines=True), F.lit(HEAD))
    rows = messages.select("conv_id", "at", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.select(
        "conv_id",
        "at",
        F.concat("head", "body", F.lit(CLOSE)).alias("turn"),
        F.length("head").cast("long").alias("skip"),
        F.length("body").cast("long").alias("length"),
        F.octet_length("head").cast("long").alias("byte_skip"),
        F.octet_length("body").cast("long").alias("byte_length"),
        F.col("role").isin(*loss_roles).alias("masked"),
    )
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0)) + F.col("skip")
    byte_start = F.coalesce(F.sum(F.octet_length("turn").cast("long")).over(before), F.lit(0)) + F.col("byte_skip")
    rows = rows.withColumns({"start": start, "byte_start": byte_start})
    spans = ["start", "length", "byte_start", "byte_length"]
    whole = F.sort_array(F.collect_list(F.struct("at", "turn", "masked", *spans)))
    return rows.groupBy("conv_id").agg(whole.alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["masked"]), lambda t: F.struct(*[t[c].alias(c) for c in spans])
        ).alias("loss"),
    )


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Fold a log and render its conversations. An empty log gives no rows; other columns are not read."""
    return render(fold(events), loss_roles)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a rendered conversation."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def one(turn: Column) -> Column:
        head = F.substring_index(turn, HEAD, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        return F.struct(
            unescape(role).alias("role"), unescape(F.substr(turn, F.length(head) + F.lit(len(HEAD) + 1))).alias("text")
        )

    return F.transform(turns, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the mask, in order.

    Each is cut out by its bytes: places in characters are counted from the start of the conversation, again for every
    text, places in bytes are not.
    """

    def cut(raw: Column) -> Column:
        return F.transform(loss, lambda s: unescape(F.substring(raw, s["byte_start"].cast("int") + 1, s["byte_length"].cast("int")).cast("string")))

    return let(formatted.cast("binary"), cut)
