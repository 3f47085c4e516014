"""Chat formatting from event logs.

A log holds, for each conversation, numbered events: `message` begins a message, `delta` appends text to one, `edit`
replaces the text of one, and `regenerate` begins one anew and drops all that began after it. The last state of every
message is folded from its sorted events, and the messages are rendered with turn markers and a loss mask.

Control strings inside texts are escaped reversibly: `%` becomes `%25` and `<|` becomes `%3C|`; in roles a line break
becomes `%0A` too. An escaped text thus holds no `<|`, and every `%` in it begins an escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts carry loss.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A log in which every row is a message, numbered by turn; rows of one turn follow role and text."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), F.lit(None).cast("long").alias("target"), "role", "text")


def messages_of(events: DataFrame) -> DataFrame:
    """conv_id, message (from 0), role and text of every message that is left after all events.

    events: conv_id, seq, op, target, role, text. Events are sorted by seq, then op (messages first), role and text;
    a null seq comes first. target is the number that a message got when it began, and null means the latest one.
    Null text is empty, a null role an empty role. Events before any message, with an unknown op, or with a target that
    doesn't exist are ignored, and repeated rows are events of their own. An empty log gives no messages.
    """
    order = ["seq", F.when(F.col("op") == "message", 0).otherwise(1), "role", "text"]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    log = events.select("conv_id", "seq", "op", "target", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = log.withColumns({"at": F.row_number().over(conv), "latest": F.sum(F.when(F.col("op") == "message", 1).otherwise(0)).over(conv.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    own = F.when(F.col("op") == "message", F.col("latest")).when(F.col("op").isin("delta", "edit", "regenerate"), F.coalesce("target", "latest"))
    log = log.withColumn("message", own).where((F.col("message") >= 0) & (F.col("message") <= F.col("latest")))
    # a regenerated message drops every message with a larger number that had begun by then
    whole = Window.partitionBy("conv_id")
    cuts = F.filter(F.collect_list(F.when(F.col("op") == "regenerate", F.struct("at", "message"))).over(whole), lambda c: c.isNotNull())
    log = log.withColumn("cuts", cuts).where(~F.exists("cuts", lambda c: (c["message"] < F.col("message")) & (c["at"] > F.col("at")))).drop("cuts")
    state = F.array_sort(F.collect_list(F.struct("at", "op", "role", "text")))
    folded = log.groupBy("conv_id", "message").agg(state.alias("events"), F.min(F.when(F.col("op") == "message", F.struct("at", "role"))).alias("first")).where("first is not null")
    last = F.array_max(F.transform("events", lambda e, i: F.when(e["op"] != "delta", i + 1).otherwise(0)))
    return folded.select("conv_id", "message", F.col("first.role").alias("role"), F.array_join(F.transform(F.slice("events", last, F.size("events")), lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted and segments; the segments' texts make up formatted, and loss marks those to learn from."""
    turn = lambda m: F.array(
        F.struct(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(m["text"]).alias("text"), (m["role"] == learned).alias("loss")),
        F.struct(F.lit(f"{END}\n").alias("text"), F.lit(False).alias("loss")),
    )
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "role", "text"))).alias("turns"))
    segments = turns.select("conv_id", F.flatten(F.transform("turns", turn)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def format_chats(events: DataFrame, learned: str = LEARNED) -> DataFrame:
    """The rendered conversations of a log; one row a conversation that has a message, a null conv_id being one too."""
    return render(messages_of(events), learned)


def parse(formatted: Column) -> Column:
    """Role and text of each turn, read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, START.replace("|", "\\|"), -1), lambda _, i: i > 0)
    body = lambda p: F.substring(p, F.locate("\n", p) + 1, F.length(p))
    text = lambda b: F.substring(b, F.lit(1), F.length(b) - len(END) - 1)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(text(body(p))).alias("text")))


def digest(chats: DataFrame) -> DataFrame:
    """What a formatted conversation says when it is read back: turns and the text under the loss mask."""
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    read = chats.select("conv_id", parse(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
