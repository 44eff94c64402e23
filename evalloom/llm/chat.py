"""Chat formatting: the same dialogue from every participant's side.

For every speaker of a conversation the dialogue is rendered once with that speaker as
``assistant`` and everybody else as ``user`` under their own name; system turns stay system turns
in all of them. Only what the assistant says is trained on, so its spans carry the mask.

A rendered turn is ``<|role|>`` or ``<|user:NAME|>``, a line break, the text, ``<|end|>``, a line
break. Spans cover text and end mark of the assistant's turns.

Long dialogues come in parts of ``TURNS_PER_PART`` consecutive rows; the rendered dialogue is the parts joined in
order, and spans count characters (code points) from the start of their part. Parts go by a row's position in its
conversation, so no cell holds more rows, however often a turn number repeats or is missing. A position is the rows of
earlier turns, plus those of the same turn with a smaller digest prefix, plus those before it there: equal rows are counted
first, so that none of the three steps brings a conversation, a turn or all copies of a row into one task.

Defined cases: a null role is the speaker ``unknown``; a null text is empty; a null conv_id is a
conversation of its own; null turns come first; rows of one turn are ordered by the MD5 of speaker, line break and text,
and repeated rows are kept; a conversation of system turns only has no speaker and no output.
Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalloom.operators.ranges import running_before
from evalloom.sources.scratch import settle

SYSTEM = "system"
UNKNOWN = "unknown"
TURNS_PER_PART = 64
#: Hex digits of a digest that part the rows of one turn.
DIGEST_DIGITS = 3


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def with_position(turns: DataFrame) -> DataFrame:
    """Add ``pos``, a row's place in its conversation from 0."""
    digest = F.md5(F.concat("speaker", F.lit("\n"), "text").cast("binary"))
    alike = turns.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"))
    alike = settle(alike.withColumn("digest", digest).withColumn("cell", F.substring("digest", 1, DIGEST_DIGITS)))
    cells = settle(alike.groupBy("conv_id", "turn", "cell").agg(F.sum("copies").alias("n")))
    whole = running_before(settle(cells.groupBy("conv_id", "turn").agg(F.sum("n").alias("n"))), ["conv_id"], "turn", "n", "earlier")
    whole = whole.select(F.struct("conv_id", "turn").alias("key"), "earlier")
    # A turn has at most 16 ** DIGEST_DIGITS cells.
    in_turn = W.partitionBy("conv_id", "turn").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.withColumn("inside", F.coalesce(F.sum("n").over(in_turn), F.lit(0))).withColumn("key", F.struct("conv_id", "turn")).join(whole, "key")
    starts = starts.select(F.struct("conv_id", "turn", "cell").alias("key"), (F.col("earlier") + F.col("inside")).alias("start"))
    in_cell = W.partitionBy("conv_id", "turn", "cell").orderBy("digest", "speaker", "text").rowsBetween(W.unboundedPreceding, -1)
    placed = alike.withColumn("before", F.coalesce(F.sum("copies").over(in_cell), F.lit(0)))
    placed = placed.withColumn("key", F.struct("conv_id", "turn", "cell")).join(starts, "key")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return placed.select("conv_id", "turn", "speaker", "text", "start", "before", copy).select(
        "conv_id", "turn", "speaker", "text", (F.col("start") + F.col("before") + F.col("copy")).cast("long").alias("pos")
    )


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, piece, loss): one row per turn and perspective."""
    return _rotated(_turns(conversations))


def _rotated(turns: DataFrame) -> DataFrame:
    """Turns from every side, with whatever else their rows hold.

    The speakers of a conversation come from a pre-aggregated distinct; the join on conv_id has few
    rows per conversation on that side, and a hot conversation on the other is split by adaptive execution.
    """
    others = [c for c in turns.columns if c not in ("conv_id", "turn", "speaker", "text")]
    sides = turns.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(sides, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    head = F.when(role == "user", F.concat(F.lit("<|user:"), "speaker", F.lit("|>\n"))).otherwise(
        F.concat(F.lit("<|"), role, F.lit("|>\n"))
    )
    return seen.select(
        "conv_id", "perspective", "turn", "speaker", role.alias("role"), "text", head.alias("head"),
        F.concat(head, "text", F.lit("<|end|>\n")).alias("piece"), own.alias("loss"), *others,
    )


def render(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, perspective, part, n_turns, rendered, spans): masks as (start, end) character spans.

    ``part`` is ``floor(pos / turns_per_part)`` of a row's position in its conversation.
    """
    part = F.floor(F.col("pos") / turns_per_part).cast("long")
    rows = _rotated(with_position(_turns(conversations))).withColumn("part", part)
    keys = ["conv_id", "perspective", "part"]
    order = W.partitionBy(*keys).orderBy("pos")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("at", F.row_number().over(order)).withColumn("before", before)
    span = F.struct(
        (F.col("before") + F.length("head")).cast("long").alias("start"),
        (F.col("before") + F.length("piece") - 1).cast("long").alias("end"),
    )
    pieces = F.array_sort(F.collect_list(F.struct("at", "piece")))
    spans = F.array_sort(F.collect_list(F.when(F.col("loss"), F.struct("at", span.alias("s")))))
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("rendered"),
        F.transform(spans, lambda s: s["s"]).alias("spans"),
    )
