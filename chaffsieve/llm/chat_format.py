"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that participant as the assistant and all
others as named users; the mask has the character spans of the assistant's own words.

The unit of output is a range of at most BLOCK neighbouring messages, whatever the size of the conversation: range k of
a perspective has the messages from k * BLOCK on, and all offsets count from the beginning of the whole dialogue. Read in
the order of `chunk`, the ranges of a perspective are its dialogue.

The number of a message and the offset of a range are prefix sums over a conversation. These are taken over a tree of
FAN children a node (digits of the turn, then digits of the tie), so that no task ever gathers a whole conversation or a
crowded turn, and nothing of the result depends on how deep the tree has to be.

Defined cases: messages of one turn stand in the order of the MD5 of speaker and text, then of speaker and text; exact
repetitions of a message are one message; system messages are rendered as such and are no participants' own, so a
conversation of only these has no rows; null and empty texts are rendered empty with an empty span; a null role is the
participant "unknown"; a null turn stands as turn -1; rows with null conv_id are left out; other columns are ignored.
Names are rendered as they are, whatever they hold: a participant called "assistant" is a user of that name to the
others, and marks of the format inside names or texts are not escaped; the mask is taken from lengths, not from marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chaffsieve.llm._common import written

#: Messages in a range.
BLOCK = 256
#: Children of a node of the tree, as a power of two, and messages of a turn that one window may order.
BITS, CROWD = 8, 1024
SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE, OTHER, OWN = "<|im_start|>", "<|im_end|>\n", "user name=", "assistant"


def _said(conversations: DataFrame) -> DataFrame:
    said = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return said.distinct().withColumn("tie", F.md5(F.concat("role", F.lit("\n"), "text").cast("binary")))


def _levels(low: int, high: int) -> list[int]:
    """Shifts of the levels above the values low to high, until one node has them all as children."""
    out, shift = [], 0
    while (high >> shift) - (low >> shift) >= 1 << BITS:
        shift += BITS
        out.append(shift)
    return out


def _before(nodes: DataFrame, group: list[str], keys: list[list[Column]], value: str) -> DataFrame:
    """The nodes with `before`: the sum of `value` over the nodes of their group that stand before them.

    keys: for every level, from the leaves up, the columns that order and identify its nodes; each of `nodes` is a leaf. A
    window sees the children of one node; what stands before that node comes from the levels above."""
    names = [[f"_k{at}_{i}" for i in range(len(own))] for at, own in enumerate(keys)]
    keyed = out = nodes.withColumns({n: c for own, level in zip(keys, names, strict=True) for n, c in zip(level, own, strict=True)})
    for at, own in enumerate(names):
        up = names[at + 1] if at + 1 < len(names) else []
        window = Window.partitionBy(*group, *up).orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
        so_far = F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long").alias(f"_b{at}")
        if at == 0:
            out = out.select("*", so_far)
        else:
            summed = keyed.groupBy(*group, *own, *up).agg(F.sum(value).alias(value))
            out = out.join(summed.select(*group, *own, so_far), [*group, *own])
    total = sum((F.col(f"_b{at}") for at in range(1, len(keys))), F.col("_b0"))
    return out.select(*nodes.columns, total.alias("before"))


def numbered(said: DataFrame) -> DataFrame:
    """The messages with k, their number in the conversation."""
    turns = said.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    low, high, most = turns.agg(F.min("turn"), F.max("turn"), F.max("n")).first()
    digits = 0  # hexadecimal digits of the tie that part a crowded turn
    while most and most > CROWD << (4 * digits) and digits < 15:
        digits += 1
    part = F.conv(F.substring("tie", 1, digits), 16, 10).cast("long") if digits else F.lit(0).cast("long")
    said = said.withColumn("part", part)
    leaves = said.groupBy("conv_id", "turn", "part").agg(F.count("*").alias("n"))
    keys = [[F.col("turn"), F.shiftright("part", s)] for s in [0, *_levels(0, 16**digits - 1)]] if digits else []
    keys += [[F.shiftright("turn", s)] for s in [0, *(_levels(low, high) if most else [])]]
    place = _before(leaves, ["conv_id"], keys, "n").select("conv_id", "turn", "part", "before")
    own = Window.partitionBy("conv_id", "turn", "part").orderBy("tie", "role", "text")
    rank = said.withColumn("rank", F.row_number().over(own) - 1)
    return rank.join(place, ["conv_id", "turn", "part"]).select(
        "conv_id", (F.col("before") + F.col("rank")).alias("k"), "role", "text"
    )


def rotated(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, chunk (number of the range), first_message (its first message's number), n_turns (messages),
    start (offset of its text in the dialogue), text, mask (array of start and end, end exclusive, offsets in the
    dialogue). Lengths are code points."""
    messages = written(numbered(written(_said(conversations), "said")), "messages")
    chunks = (
        messages.groupBy("conv_id", F.floor(F.col("k") / BLOCK).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("k", "role", "text"))).alias("messages"))
    )
    sizes = written(_sizes(messages), "sizes")
    speakers = sizes.filter(F.col("speaker") != SYSTEM).select("conv_id", "speaker").distinct()
    rendered = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(
                F.lit(OPEN),
                F.when(m["role"] == F.col("speaker"), F.lit(OWN))
                .when(m["role"] == SYSTEM, F.lit(SYSTEM))
                .otherwise(F.concat(F.lit(OTHER), m["role"])),
                F.lit("\n"),
            ).alias("head"),
            m["text"].alias("text"),
            (m["role"] == F.col("speaker")).alias("own"),
        ),
    )
    spans = F.expr(
        f"""aggregate(parts, named_struct('at', start, 'own', cast(array() as array<struct<start:bigint,end:bigint>>)),
          (a, p) -> named_struct(
            'at', a.at + length(p.head) + length(p.text) + {len(CLOSE)},
            'own', if(p.own, concat(a.own, array(named_struct(
              'start', a.at + length(p.head), 'end', a.at + length(p.head) + length(p.text)))), a.own)),
          a -> a.own)"""
    )
    rows = chunks.join(speakers, "conv_id").join(_starts(sizes, speakers), ["conv_id", "speaker", "chunk"], "left")
    return (
        rows.withColumn("start", F.coalesce("start", F.lit(0)).cast("long"))
        .withColumn("parts", rendered)
        .select(
            "conv_id",
            "speaker",
            "chunk",
            (F.col("chunk") * BLOCK).alias("first_message"),
            F.size("messages").cast("long").alias("n_turns"),
            "start",
            F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "").alias("text"),
            spans.alias("mask"),
        )
    )


def _sizes(messages: DataFrame) -> DataFrame:
    """conv_id, chunk and speaker: the size of the speaker's messages in a range as others see them, and by how much it
    differs in the speaker's own perspective."""
    label = F.when(F.col("role") == SYSTEM, F.lit(len(SYSTEM))).otherwise(F.length("role") + len(OTHER))
    return messages.groupBy("conv_id", F.floor(F.col("k") / BLOCK).alias("chunk"), F.col("role").alias("speaker")).agg(
        F.sum((F.length("text") + label + len(OPEN) + 1 + len(CLOSE)).cast("long")).alias("size"),
        F.sum((F.lit(len(OWN)) - label).cast("long")).alias("own"),
    )


def _starts(sizes: DataFrame, speakers: DataFrame) -> DataFrame:
    """conv_id, speaker, chunk and start for the ranges of conversations of more than one; a first range starts at 0.

    A message is as long for all perspectives but its speaker's own, so the lengths as others see them are summed once,
    and each speaker's own messages are what differs."""
    keys = [[F.shiftright("chunk", s)] for s in [0, *_levels(0, sizes.agg(F.max("chunk")).first()[0] or 0)]]
    common = sizes.groupBy("conv_id", "chunk").agg(F.sum("size").alias("n"))
    several = common.filter("chunk = 1").select("conv_id")
    common = _before(common.join(several, "conv_id"), ["conv_id"], keys, "n")
    common = common.select("conv_id", "chunk", F.col("before").alias("start"))
    own = sizes.select("conv_id", "speaker", "chunk", F.col("own").alias("n"))
    every = common.join(speakers, "conv_id").join(own, ["conv_id", "speaker", "chunk"], "left").fillna(0, ["n"])
    return _before(every, ["conv_id", "speaker"], keys, "n").select(
        "conv_id", "speaker", "chunk", (F.col("start") + F.col("before")).alias("start")
    )
