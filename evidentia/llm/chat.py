"""Chat formatting with every participant in turn as the assistant; DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Turns that one row holds at most: a longer dialogue is handed over in pieces of its one rendering.
PIECE_TURNS = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Where turns without a number stand.
NO_TURN = -(1 << 63)


def _segment(message: Column, speaker: Column) -> Column:
    """head, body and tail of a rendered message, and whether it is the speaker's own."""
    own = message["role"] == speaker
    name = F.when(own, F.lit("assistant")).when(message["role"] == "system", F.lit("system")).otherwise(
        F.concat(F.lit("user name="), message["role"])
    )
    return F.struct(
        F.concat(F.lit(OPEN), name, F.lit("\n")).alias("head"),
        F.concat(message["text"], F.lit(CLOSE)).alias("body"), F.lit("\n").alias("tail"), own.alias("own"),
    )


def _ranked(rows: DataFrame, keys: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """Distinct rows with ``n``, how many there are of each, and ``rank``, how many rows of the same keys stand before them.

    Repeated rows are counted before they are shuffled. Ranges of the order, written once so that they cannot
    change, are ranked each by itself; sums over the ranges, as many as partitions, tell where each begins.
    """
    counted = rows.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("n"))
    ranges = counted.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id())
    ranges = scratch.keep(ranges, "ranges")
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    base = ranges.groupBy(*keys, "range").agg(F.sum("n").alias("held")).select(
        *[F.col(k).alias(f"b_{k}") for k in keys], F.col("range").alias("b_range"), F.coalesce(F.sum("held").over(before), zero).alias("base")
    )
    met = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys] + [F.col("range") == F.col("b_range")]
    own = ranges.withColumn("own", F.coalesce(F.sum("n").over(inside), zero)).join(base, met)
    return own.select(*keys, *order, "n", (F.col("base") + F.col("own")).alias("rank"))


def rotate(
    chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    piece_turns: int = PIECE_TURNS,
) -> DataFrame:
    """One row per conversation, participant and piece: conv_id, speaker, piece, n_turns, n_masked, text, masks.

    For every participant, any role but ``system``, the whole dialogue is rendered with that speaker as
    assistant, system turns as they are and all others as users with their names. ``masks``
    lists the spans to learn from, the assistant's words and their end mark, as start:end in
    code points of the whole rendering, end exclusive. A conversation without participants gives no rows.

    Turns go by number, role and text; repeated rows are all rendered. A dialogue of up to ``piece_turns`` turns is one row. That of
    a longer one comes in pieces of as many turns, so that no row or task holds a conversation of any size:
    the texts of its pieces, put together in order, are the rendering of the whole dialogue.

    A turn without a number comes first. A null text is empty, a null role is ``unknown``, a
    null conversation is one of its own. The opening mark inside a text gets a blank, so that texts cannot
    forge turns. Other columns are ignored. No rows, no result.
    """
    scratch = Scratch(chats.sparkSession)
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = chats.select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(NO_TURN)).alias("turn"),
        F.replace(F.coalesce(F.col(role_col), F.lit("unknown")), F.lit("<|"), F.lit("< |")).alias("role"), text.alias("text"),
    )
    people = rows.groupBy("conv").agg(
        F.array_sort(F.collect_set(F.when(F.col("role") != "system", F.col("role")))).alias("people"), F.count(F.lit(1)).alias("size")
    ).withColumnRenamed("conv", "p_conv")
    people = scratch.keep(people, "people")
    # Sizes were summed before the shuffle; only conversations of more turns than a piece are ranked.
    large = people.where(F.col("size") > piece_turns).select(F.col("p_conv").alias("l_conv"))
    met = F.col("conv").eqNullSafe(F.col("l_conv"))
    ranked = _ranked(rows.join(large, met, "left_semi"), ["conv"], ["turn", "role", "text"], scratch)
    first, last = F.floor(F.col("rank") / piece_turns), F.floor((F.col("rank") + F.col("n") - 1) / piece_turns)
    pieces = ranked.withColumn("piece", F.explode(F.sequence(first, last))).withColumn("copies", (
        F.least(F.col("rank") + F.col("n"), (F.col("piece") + 1) * piece_turns) - F.greatest("rank", F.col("piece") * piece_turns)
    ).cast("int")).drop("n", "rank")
    short = rows.join(large, met, "left_anti").withColumns({"piece": F.lit(0).cast("long"), "copies": F.lit(1)})
    long = scratch.keep(_rendered(pieces, people), "long")
    # Where a piece begins in its dialogue: sums of the lengths of those before, a number for each piece.
    before = Window.partitionBy("b_conv", "b_speaker").orderBy("b_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = long.select(F.col("conv").alias("b_conv"), F.col("speaker").alias("b_speaker"), F.col("piece").alias("b_piece"), "chars")
    bases = bases.withColumn("base", F.coalesce(F.sum("chars").over(before), F.lit(0).cast("long"))).drop("chars")
    long = long.join(bases, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("speaker") == F.col("b_speaker")) & (F.col("piece") == F.col("b_piece")))
    every = _rendered(short, people).withColumn("base", F.lit(0).cast("long")).unionByName(long.drop("b_conv", "b_speaker", "b_piece"))
    masks = F.transform("spans", lambda s: F.concat_ws(":", s["start"] + F.col("base"), s["stop"] + F.col("base")))
    return every.select(F.col("conv").alias(conv_col), "speaker", "piece", "n_turns", F.size("spans").cast("long").alias("n_masked"), "text", F.array_join(masks, ",").alias("masks"))


def _rendered(turns: DataFrame, people: DataFrame) -> DataFrame:
    """conv, speaker, piece, n_turns, text, chars, spans of turns (conv, piece, turn, role, text, copies) for every participant."""
    parts = turns.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("held"))
    messages = F.flatten(F.transform("held", lambda m: F.array_repeat(F.struct(m["turn"], m["role"], m["text"]), m["copies"])))
    views = parts.join(people, F.col("conv").eqNullSafe(F.col("p_conv"))).select("conv", "piece", messages.alias("messages"), F.explode("people").alias("speaker"))
    views = views.withColumn("segments", F.transform("messages", lambda m: _segment(m, F.col("speaker"))))
    walked = F.aggregate(
        "segments", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["head"]) + F.length(s["body"]) + 1).alias("at"),
            F.when(s["own"], F.array_append(a["spans"], F.struct(
                (a["at"] + F.length(s["head"])).alias("start"), (a["at"] + F.length(s["head"]) + F.length(s["body"])).alias("stop")
            ))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    views = views.withColumn("walked", walked)
    return views.select(
        "conv", "speaker", "piece", F.size("segments").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], s["tail"])), "").alias("text"),
        F.col("walked.at").alias("chars"), F.col("walked.spans").alias("spans"),
    )
