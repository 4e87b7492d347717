"""Chat formatting from an event log. [native]

A conversation is not stored as messages but as events: `message` opens a message, `delta` adds streamed text to it,
`edit` replaces what it holds, `regenerate` empties it for a new answer and takes back the messages that stood after it.
`messages` folds a log into final messages, `render` writes each conversation by a template and marks the characters that
a model is to learn from, `turns` and `loss_text` read a rendering back.

Events are (conv_id, seq, msg, kind, role, text): seq orders the log, msg orders the messages of a conversation. Two
levels of grouping keep tasks small: events meet by message, messages by blocks of `BLOCK` neighbours; only finished
blocks of a conversation meet. What a regeneration takes back further on is known from one number a block, summed up over the blocks
of a conversation, and from the regenerations in a message's own block. An empty log gives no rows; columns other than those
named are not read; null conversation ids are one conversation, null message numbers stand first in theirs. Texts are of any
length; a rendered conversation is one string, so that it is bounded by what a string of Spark holds (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Neighbouring message numbers whose messages are rendered together.
BLOCK = 64
#: Kinds of events that begin a text.
OPENS = ("message", "edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """A turn is `turn role text_mark text end`. All marks begin with `<|`, and no escaped text or role holds `<|`."""

    turn: str = "<|turn|>"
    text_mark: str = "<|text|>"
    end: str = "<|end|>"
    learn: str = "assistant"

    def escape(self, text: Column) -> Column:
        r"""One more backslash into each `<\...\|`, so that `<|` cannot come up; nulls count as empty."""
        return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit("<$1|"))


TEMPLATE = Template()


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that leaves a finished table (conv_id, turn, role, text) behind, four events a turn at most.

    By a hash of conversation and turn, a message comes at once, streamed in two deltas, edited from a draft, or
    regenerated after a first answer. Turns that stand more than once are messages each.
    """
    alone = F.count(F.lit(1)).over(Window.partitionBy("conv_id", "turn")) == 1
    way = F.when(alone & F.col("turn").isNotNull(), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))).otherwise(0)
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), way.alias("_way"))
    half = (F.length("text") / 2).cast("int")
    first, second = F.expr("left(text, cast(length(text) / 2 as int))"), F.substring("text", half + 1, F.length("text"))
    event = lambda k, kind, text, role="role": F.struct((4 * F.col("turn") + k).alias("seq"), F.lit(kind).alias("kind"), (F.col(role) if role else F.lit(None).cast("string")).alias("role"), text.alias("text"))
    log = (
        F.when(F.col("_way") == 1, F.array(event(0, "message", first), event(1, "delta", second, None)))
        .when(F.col("_way") == 2, F.array(event(0, "message", F.lit("a draft")), event(1, "edit", F.col("text"))))
        .when(F.col("_way") == 3, F.array(event(0, "message", F.lit("a first")), event(1, "delta", F.lit(" answer"), None), event(2, "regenerate", F.lit("")), event(3, "delta", F.col("text"), None)))
        .otherwise(F.array(event(0, "message", F.col("text"))))
    )
    return rows.select("conv_id", F.col("turn").alias("msg"), F.explode(log).alias("_event")).select("conv_id", "_event.seq", "msg", "_event.kind", "_event.role", "_event.text")


def block_of(msg: Column) -> Column:
    return F.floor(msg / BLOCK)


def messages(events: DataFrame) -> DataFrame:
    """conv_id, msg, turns array<struct<role,text>>: what the log leaves of each message; one that was taken back has no row.

    Within a message, events stand by seq, then kind, role and text (nulls first), so that ties and repeated rows
    have one order; every `message` event opens a turn of its own, so that repeated rows stay. Everything before the
    last `edit` or `regenerate` of a message is void; so is what was logged to it before a `regenerate` of an earlier
    message. Deltas that nothing opens open a turn. Null roles and texts count as empty.
    """
    renewed = F.when(F.col("kind") == "regenerate", F.struct("msg", "seq"))
    again = events.groupBy("conv_id", block_of(F.col("msg")).alias("_block")).agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_top"), F.collect_list(renewed).alias("_again"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    again = again.withColumn("_before", F.max("_top").over(before)).filter("_before is not null or size(_again) > 0").select(F.col("conv_id").alias("_conv"), "_block", "_again", "_before")
    event = F.struct("seq", (~F.col("kind").isin(*OPENS)).alias("_adds"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_message = events.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(event)).alias("_events"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & block_of(F.col("msg")).eqNullSafe(F.col("_block"))
    by_message = by_message.join(again, same, "left").drop("_conv", "_block")
    own = F.array_max(F.transform(F.filter("_events", lambda e: e["kind"].isin("edit", "regenerate")), lambda e: e["seq"]))
    others = F.greatest("_before", F.array_max(F.transform(F.filter("_again", lambda a: a["msg"] < F.col("msg")), lambda a: a["seq"])))  # of what is not null
    live = F.filter("_events", lambda e: (F.col("_own").isNull() | (e["seq"] >= F.col("_own")) | e["seq"].isNull()) & (F.col("_others").isNull() | (e["seq"] > F.col("_others"))))
    by_message = by_message.withColumns({"_own": own, "_others": others}).withColumn("_live", live).filter(F.size("_live") > 0)
    opened = F.filter(F.transform("_live", lambda e, i: F.when(~e["_adds"] | (i == 0), i)), lambda i: i.isNotNull())
    by_message = by_message.withColumn("_opened", opened)
    ends = lambda k: F.coalesce(F.try_element_at(F.col("_opened"), k + 2), F.size("_live"))
    turn = lambda i, k: F.struct(F.element_at("_live", i + 1)["role"].alias("role"), F.array_join(F.transform(F.slice("_live", i + 1, ends(k) - i), lambda e: e["text"]), "").alias("text"))
    return by_message.select("conv_id", "msg", F.transform("_opened", turn).alias("turns"))


def render(folded: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, formatted string, loss array<struct<start,stop>>: code points of `formatted` that hold texts to learn from."""
    wrapped = lambda t: F.concat(F.lit(template.turn), template.escape(t["role"]), F.lit(template.text_mark))
    part = lambda t: F.struct(wrapped(t).alias("head"), template.escape(t["text"]).alias("body"), (t["role"] == template.learn).alias("learn"))
    parts = folded.select("conv_id", "msg", F.transform("turns", part).alias("_parts"))
    blocks = parts.groupBy("conv_id", block_of(F.col("msg")).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("msg", "_parts"))).alias("_all"))
    blocks = blocks.withColumn("_parts", F.flatten(F.transform("_all", lambda m: m["_parts"]))).drop("_all")
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(template.end))), "")
    # start of each part: lengths summed up, within the block
    step = lambda done, p: F.struct(
        (done["at"] + F.length(p["head"]) + F.length(p["body"]) + len(template.end)).alias("at"),
        F.when(p["learn"], F.concat(done["spans"], F.array(F.struct((done["at"] + F.length(p["head"])).alias("start"), (done["at"] + F.length(p["head"]) + F.length(p["body"])).alias("stop"))))).otherwise(done["spans"]).alias("spans"),
    )
    nothing = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))
    blocks = blocks.select("conv_id", "_block", text.alias("_text"), F.aggregate("_parts", nothing, step)["spans"].alias("_spans"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_block", "_text", "_spans"))).alias("_blocks"))
    begins = F.aggregate("_blocks", F.array(F.lit(0)), lambda done, b: F.concat(done, F.array(F.element_at(done, -1) + F.length(b["_text"]))))
    whole = whole.withColumn("_begins", begins)
    moved = lambda b, i: F.transform(b["_spans"], lambda s: F.struct((s["start"] + F.element_at("_begins", i + 1)).alias("start"), (s["stop"] + F.element_at("_begins", i + 1)).alias("stop")))
    return whole.select("conv_id", F.array_join(F.transform("_blocks", lambda b: b["_text"]), "").alias("formatted"), F.flatten(F.transform("_blocks", moved)).alias("loss"))


def turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role,text>> read back from a rendering."""
    pieces = F.filter(F.split(formatted, r"\Q" + template.turn + r"\E"), lambda p: p != "")
    body = lambda p: F.substring(p, F.instr(p, template.text_mark) + len(template.text_mark), F.length(p))
    read = lambda p: F.struct(template.unescape(F.substring_index(p, template.text_mark, 1)).alias("role"), template.unescape(F.substring_index(body(p), template.end, 1)).alias("text"))
    return F.transform(pieces, read)


def loss_text(formatted: Column, loss: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(loss, lambda s: template.unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
