"""Chat formatting: collapse cumulative snapshots of conversations, then render what is left.

A logged conversation is often a prefix of a longer one, because the client logs the whole history again at each
turn. Each turn gets two 64-bit hashes of (position, role, text); their running sums identify each prefix of each
conversation. A conversation whose own sums occur as a proper prefix elsewhere is dropped by an anti-join; of equal
conversations the one with the smallest id stays.

DataFrame functions only. The turns are dealt out by range of (conversation, turn, role, text) and sorted; what a task
holds of a conversation is a block of it. Prefixes are summed within blocks, whose sums are then put together, so a
conversation that holds a large share of all rows is spread over many tasks, whatever its turn numbers. Only hashes and
places go through the further shuffles, texts once more to be rendered.

Defined results: rows without conv_id belong to no conversation and are left out; null role and null text count as
empty; fully repeated rows count once; turns with equal number are ordered by role and text, a null turn is the
first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import narrow, stored

#: How a turn is written; {role} and {text} stand for the turn's own.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
#: Bits of a place that count rows of a task; the others number the tasks in ascending order.
PLACE_BITS = 33


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (ascending with turn, role and text), blk, role, text; repeated rows once."""
    rows = narrow(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id IS NOT NULL")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = rows.repartitionByRange(*order).distinct().sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(placed.select("conv_id", "place", F.shiftright("place", PLACE_BITS).alias("blk"), "role", "text"), "turns")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n (turns of the conversation), h1, h2: sums that identify the prefix up to pos."""
    in_block = Window.partitionBy("conv_id", "blk").orderBy("place")
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    hashed = turns.select("conv_id", "blk", "place", F.xxhash64(F.lit(1), "role", "text").alias("c1"), F.xxhash64(F.lit(2), "text", "role").alias("c2"))
    sizes = (
        turns.groupBy("conv_id", "blk").agg(F.count("*").alias("size"), F.min("place").alias("first"))
        .select("conv_id", "blk", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"), F.sum("size").over(Window.partitionBy("conv_id")).alias("n"))
    )
    # places of a block follow one another
    placed = hashed.join(sizes, ["conv_id", "blk"]).withColumn("pos", F.col("place") + F.col("shift"))
    lanes = {f"g{i}": F.xxhash64(F.lit(i), "pos", "c1", "c2").cast("decimal(20,0)") for i in (1, 2)}
    running = in_block.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns(lanes).select("conv_id", "blk", "pos", "n", *[F.sum(f"g{i}").over(running).cast("decimal(38,0)").alias(f"s{i}") for i in (1, 2)])
    ends = local.groupBy("conv_id", "blk").agg(F.max_by("s1", "pos").alias("e1"), F.max_by("s2", "pos").alias("e2"))
    shifts = ends.select("conv_id", "blk", *[F.coalesce(F.sum(f"e{i}").over(before), F.lit(0)).cast("decimal(38,0)").alias(f"b{i}") for i in (1, 2)])
    return local.join(shifts, ["conv_id", "blk"]).select("conv_id", "pos", "n", (F.col("s1") + F.col("b1")).alias("h1"), (F.col("s2") + F.col("b2")).alias("h2"))


def _maximal(turns: DataFrame) -> DataFrame:
    sums = stored(_prefix_sums(turns), "prefixes")
    whole = sums.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = sums.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations equal to it, itself included) of those that are no prefix of a longer one."""
    return _maximal(_turns(conversations))


def format_chats(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, rendered."""
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    turns = _turns(conversations)
    kept = _maximal(turns)
    piece = F.concat(F.lit(head), F.col("role"), F.lit(middle), F.col("text"), F.lit(tail))
    entries = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", "blk").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("ts"))
    blocks = entries.select("conv_id", F.struct("blk", F.array_join(F.col("ts.piece"), "").alias("part")).alias("b"))
    texts = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs")).select("conv_id", F.array_join(F.col("bs.part"), "").alias("rendered"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l,
             string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
      FROM t GROUP BY conv_id),
u AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM c GROUP BY l)
SELECT conv_id, len(l)::BIGINT AS n_turns, n_copies, rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM u AS v WHERE len(v.l) > len(u.l) AND v.l[1:len(u.l)] = u.l)
"""
