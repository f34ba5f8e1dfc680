"""Chat training texts by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant and all others as named users; only the speaker's own turns are to be
learned, and the mask says where they stand.  System turns are instructions for all and
belong to no participant.

A long conversation is cut into parts of :data:`TURNS` turn numbers, so no task or row
holds a whole one; ``char_start`` is a part's place in the whole rendering.

Defined results: rows without conversation or role are left out; a null turn number
stands before all others; a null text is empty; turns of one number are ordered by role
and text, and rows that repeat number, role and text count once; a conversation without
participants, and an empty table, give no rows; other columns are not read.  Characters
of a name other than ASCII letters, digits, ``_``, ``.`` and ``-`` become ``_``; where that
makes names of a conversation equal, all but the first in order get ``~2``, ``~3`` and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of a part.
TURNS = 256
SYSTEM = "system"
#: The marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotated_turns(turns: DataFrame) -> DataFrame:
    """Each turn once for each participant: conv_id, speaker, part, place, header, body, own."""
    told = turns.where("conv_id is not null and role is not null").select(
        "conv_id",
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / TURNS).cast("long").alias("part"),
        F.col("turn").cast("long").alias("turn"),
        F.trim("role").alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text"),
    )
    name = F.regexp_replace("role", "[^A-Za-z0-9_.-]", "_")
    alike = Window.partitionBy("conv_id", "name").orderBy("role")
    roles = told.where(F.col("role") != SYSTEM).select("conv_id", "role", name.alias("name")).distinct()
    roles = roles.withColumn("same", F.row_number().over(alike))
    # names of those whose plain name an earlier one of the conversation has
    later = F.struct("role", F.concat("name", F.lit("~"), F.col("same").cast("string")))
    renamed = roles.where("same > 1").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(later)).alias("renamed"))
    speakers = roles.select("conv_id", F.col("role").alias("speaker")).join(renamed, "conv_id", "left")
    own = F.col("role") == F.col("speaker")
    name = F.coalesce(F.try_element_at("renamed", F.col("role")), name)
    header = (
        F.when(own, F.lit("assistant"))
        .when(F.col("role") == SYSTEM, F.lit(SYSTEM))
        .otherwise(F.concat(F.lit("user name="), name))
    )
    return told.join(speakers, "conv_id").select(
        "conv_id", "speaker", "part", "turn", "role", "text", own.alias("own"), F.concat(F.lit(OPEN), header, F.lit("\n")).alias("header")
    )


def render(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_own, char_start, text and mask.

    ``mask`` lists ``start:end`` of what is to be learned, in code points of the whole
    rendering.  The join is on the conversation; the rest works within one part, in one
    shuffle, and on a row for each part.
    """
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    part = Window.partitionBy("conv_id", "speaker", "part")
    line = part.orderBy(*order)
    same = F.lag(F.struct("turn", "role", "text")).over(line).eqNullSafe(F.struct("turn", "role", "text"))
    piece = F.concat("header", "text", F.lit(CLOSE))
    once = rotated_turns(turns).withColumn("again", same).where("not again").withColumn("piece", piece)
    placed = once.withColumn("nth", F.row_number().over(line)).withColumn(
        "at", F.sum(F.length("piece")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")
    )
    pieces = F.array_sort(F.collect_list(F.struct("nth", "piece")))
    mask = F.struct((F.col("at") + F.length("header")).alias("start"), (F.col("at") + F.length("piece")).alias("end"))
    parts = placed.groupBy("conv_id", "speaker", "part").agg(
        F.count("*").alias("n_turns"),
        F.count_if("own").alias("n_own"),
        F.sum(F.length("piece")).alias("size"),
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("own"), mask))).alias("spans"),
    )
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    told = F.transform("spans", lambda s: F.concat_ws(":", (s["start"] + F.col("char_start")).cast("string"), (s["end"] + F.col("char_start")).cast("string")))
    return parts.withColumn("char_start", start).select(
        "conv_id", "speaker", "part", "n_turns", "n_own", "char_start", "text", F.array_join(told, ",").alias("mask")
    )
