"""Chat formatting from an event log.

A conversation's log is partitioned by conversation, put in the order of its sequence numbers and folded into final messages:
message   a whole message at its turn
delta     text to append to the message of its turn
edit      new text in place of the message of its turn
regenerate  empties the message of its turn (later deltas fill it again) and removes every later turn written before it
The messages are then rendered by a template; spans of the rendered text that count for the loss are kept beside it.

The fold is relational: the events after the last reset of a turn are what remains of it, and a running maximum over turns
finds the regenerations that removed it. A turn's events meet in one group and a conversation's turns in another; the
rendered conversation is one row, so it is the one thing that has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strings that the template uses, which a text can't hold unescaped.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>"
TURN_END = "</s>"
#: A control string's first character becomes an entity; an entity in the text gets one more "amp;".
ENTITY = r"&(?=(?:amp;)*(?:lt;|#91;))"


def escape(text: Column) -> Column:
    """Reversible: no control string is left, and text without control strings or entities stays as it is."""
    text = F.regexp_replace(text, ENTITY, "&amp;")
    text = F.regexp_replace(text, r"<(?=/?s>|</?SYS>>)", "&lt;")
    return F.regexp_replace(text, r"\[(?=/?INST\])", "&#91;")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"&lt;(?=/?s>|</?SYS>>)", "<")
    text = F.regexp_replace(text, r"&#91;(?=/?INST\])", "[")
    return F.regexp_replace(text, r"&amp;(?=(?:amp;)*(?:lt;|#91;))", "&")


def fold(events: DataFrame) -> DataFrame:
    """events: conv_id, seq, kind, turn, role, text -> conv_id, turn, at, role, text: the final messages, at: their order within the turn.

    Null ids form one conversation, and a null turn or seq comes before all others. Null text is empty. Messages with the same turn and seq stay
    side by side, by role and text; repeated rows stay repeated. Of deltas with the same seq, those of the smaller text come first.
    A turn's role is that of its first remaining event that has one. A turn with nothing but an emptied message is an empty message.
    """
    e = events.select("conv_id", "turn", "seq", "kind", "role", F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    seq = F.coalesce(F.col("seq"), F.lit(-(2**62)))
    part = F.struct(seq.alias("seq"), F.col("role"), F.col("text"), F.col("kind"))
    turns = e.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), seq)).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", seq)).alias("again"),
        F.collect_list(part).alias("parts"),
    )
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("again").over(before))
    live = F.array_sort(F.filter("parts", lambda p: (p["seq"] >= F.coalesce("reset", F.lit(-(2**62)))) & (F.col("cut").isNull() | (p["seq"] > F.col("cut")))))
    turns = turns.withColumn("live", live).filter(F.size("live") > 0)
    whole = F.filter("live", lambda p: p["kind"] == "message")
    first_role = F.filter("live", lambda p: p["role"].isNotNull())[0]["role"]
    # a reset comes before the deltas of its own number
    text = F.array_join(F.transform(F.filter("live", lambda p: p["kind"] != "delta"), lambda p: p["text"]), "")
    more = F.array_join(F.transform(F.filter("live", lambda p: p["kind"] == "delta"), lambda p: p["text"]), "")
    one = F.array(F.struct(F.when(F.size(F.filter("live", lambda p: p["role"].isNotNull())) > 0, first_role).alias("role"), F.concat(text, more).alias("text")))
    many = F.transform(whole, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    return turns.select("conv_id", "turn", F.posexplode(F.when((F.size(whole) > 1) & (F.size(whole) == F.size("live")), many).otherwise(one)).alias("at", "m")).select("conv_id", "turn", "at", F.col("m.role"), F.col("m.text"))


def render(messages: DataFrame) -> DataFrame:
    """messages of fold() -> conv_id, formatted, loss_spans (array of start and length in code points, of the assistant's texts as they stand there).

    Each turn is the turn mark with its role, a line end, the escaped text and the end mark. A null role is written as an empty one.
    """
    head = F.concat(F.lit("<s>[INST]"), escape(F.coalesce("role", F.lit(""))), F.lit("[/INST]\n"))
    body = escape(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "at")
    m = messages.select("conv_id", "turn", "at", "role", head.alias("head"), body.alias("body"))
    m = m.withColumn("n", F.row_number().over(order)).withColumn("end", F.sum(F.length("head") + F.length("body") + len(TURN_END)).over(order))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - len(TURN_END) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length")))
    return m.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(TURN_END)).alias("piece")))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def format_chat(events: DataFrame) -> DataFrame:
    """events -> a row for each conversation that has any message: conv_id, formatted, loss_spans. See fold() and render()."""
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans -> conv_id, turns (array of role, text), loss_text: what the output says, unescaped.

    The text is cut at the end marks. A turn counts for the loss if a span starts where its text does and is as long; the spans are walked
    beside the turns, so the work is in proportion to the text.
    """
    pieces = F.posexplode(F.filter(F.split("formatted", TURN_END), lambda p: p != "")).alias("at", "piece")
    cut = r"(?s)^<s>\[INST\](.*?)\[/INST\]\n(.*)$"
    p = formatted.select("conv_id", pieces).select("conv_id", "at", "piece", F.regexp_extract("piece", cut, 1).alias("role"), F.regexp_extract("piece", cut, 2).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("at")
    p = p.withColumn("start", F.sum(F.length("piece") + len(TURN_END)).over(order) - len(TURN_END) - F.length("body"))
    spans = formatted.select("conv_id", F.explode("loss_spans").alias("s")).select("conv_id", F.col("s.start").alias("start"), F.col("s.length").alias("length"), F.lit(True).alias("loss"))
    # ids may be null, so the two sides meet null-safely
    s = spans.withColumnRenamed("conv_id", "c").withColumnRenamed("start", "b")
    p = p.join(s, p["conv_id"].eqNullSafe(s["c"]) & (p["start"] == s["b"]) & (F.length(p["body"]) == s["length"]), "left").drop("c", "b")
    # two empty texts can't start at one place: each turn has its marks
    turn = F.struct("at", unescape(F.col("role")).alias("role"), unescape(F.col("body")).alias("text"), F.coalesce("loss", F.lit(False)).alias("loss"))
    t = p.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return t.select("conv_id", "turns", F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "").alias("loss_text"))
