"""Collapse of cumulative chat snapshots, then rendering; DataFrame functions only.

A logged conversation that is a prefix of a longer one was a snapshot of it. Every turn gets the
hash of the conversation up to it: turn hashes carry their position, so the hash of a prefix is
their exclusive or, and two such hashes of 64 bits stand for the prefix. A conversation whose whole
hash and length are found among the shorter prefixes of others leaves by an anti-join; of equal
conversations the least id stays.

Turns are dealt by ranges of (conversation, turn, role, beginning of the text) and written in that
order, so a conversation that holds a third of all rows lies in many files, whatever its turn
numbers are. A turn is placed inside its file's piece of the conversation. Only conversations that
cross files need the sizes and hashes of their earlier pieces; a file has two such pieces at most,
so these small tables are broadcast. Prefixes are made distinct before they meet, so a first turn
or a conversation with many copies is one row. Rendering keeps parts of ``BLOCK`` turns: a
conversation of so many turns is one row, a longer one has several parts.

Defined results: null role and text count as empty; turns are ordered by turn (nulls first), role
and text, so repeated rows stay side by side and each is a turn; turns without a conv_id belong to
no conversation; an empty table gives no rows; extra columns are ignored. Control marks inside a
text are broken up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgate.llm.work import stored, table

#: Turns of a rendered part, and characters by which turns of one number are dealt.
BLOCK, BEGINNING = 512, 32
#: Bits of a row's number inside its partition in an increasing id.
ROW_BITS = 33


def _ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, file and ``at``, a number that grows in the order of turns; written once."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.col("turn").asc_nulls_first()
    dealt = rows.repartitionByRange("conv_id", turn, F.substring("role", 1, BEGINNING), F.substring("text", 1, BEGINNING))
    lined = dealt.sortWithinPartitions("conv_id", turn, "role", "text").select("conv_id", "role", "text", F.monotonically_increasing_id().alias("at"))
    return stored(lined, "turns").withColumn("file", F.shiftright("at", ROW_BITS))


def _pieces(turns: DataFrame) -> DataFrame:
    """How many turns stand before each piece of a conversation that crosses files, and its length."""
    ends = turns.groupBy("conv_id").agg(F.min("file").alias("first"), F.max("file").alias("last"))
    crossing = ends.where("first <> last").select("conv_id")  # fewer than files
    own = turns.join(F.broadcast(crossing), "conv_id", "left_semi").groupBy("conv_id", "file").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("conv_id")
    before = F.sum("n").over(one.orderBy("file")) - F.col("n")
    return own.select("conv_id", "file", before.alias("before"), F.sum("n").over(one).alias("whole"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, k, length, p1, p2, role, text: each turn with the hashes of the first k turns."""
    turns = _ordered(conversations)
    # two pieces a file at most
    placed = turns.join(F.broadcast(_pieces(turns)), ["conv_id", "file"], "left")
    piece = Window.partitionBy("conv_id", "file")
    line = piece.orderBy("at")
    placed = placed.withColumns({"place": F.row_number().over(line), "n": F.count(F.lit(1)).over(piece)})
    placed = placed.withColumns({"k": F.coalesce("before", F.lit(0)) + F.col("place"), "length": F.coalesce("whole", "n")})
    hashed = placed.withColumns({f"h{seed}": F.xxhash64(F.lit(seed), "k", "role", "text") for seed in (1, 2)})
    running = line.rowsBetween(Window.unboundedPreceding, 0)
    closes = (F.col("before").isNotNull() & (F.col("place") == F.col("n"))).alias("closes")
    local = stored(hashed.select("conv_id", "file", "k", "length", closes, *(F.bit_xor(f"h{s}").over(running).alias(f"l{s}") for s in (1, 2)), "role", "text"), "prefixes")
    earlier = Window.partitionBy("conv_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    ahead = local.where("closes").select("conv_id", "file", *(F.bit_xor(f"l{s}").over(earlier).alias(f"b{s}") for s in (1, 2)))
    joined = local.join(F.broadcast(ahead), ["conv_id", "file"], "left")
    whole = (F.col(f"l{s}").bitwiseXOR(F.coalesce(f"b{s}", F.lit(0))).alias(f"p{s}") for s in (1, 2))
    return joined.select("conv_id", "k", "length", *whole, "role", "text")


def maximal(every: DataFrame) -> DataFrame:
    """conv_id, length and copies of each conversation that is no prefix of a longer one, from ``prefixes``."""
    whole = every.where("k = length").groupBy("k", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = every.where("k < length").select("k", "p1", "p2").distinct()
    return whole.join(inner, ["k", "p1", "p2"], "left_anti").select("conv_id", F.col("k").alias("length"), "copies")


def collapse(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns, copies, rendered."""
    every = prefixes(conversations)
    safe = F.replace(F.col("text"), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|"), F.replace(F.col("role"), F.lit("|>"), F.lit("")), F.lit("|>\n"), safe, F.lit("<|end|>\n"))
    part = F.floor((F.col("k") - 1) / BLOCK)
    turns = every.select("conv_id", part.alias("part"), "k", line.alias("line"))
    # dealt by part, so that a long conversation isn't one task
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / BLOCK)))
    kept = turns.join(maximal(every).select("conv_id", parts.alias("part"), "copies"), ["conv_id", "part"])
    texts = kept.groupBy("conv_id", "part").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    rendered = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return texts.select("conv_id", "part", F.size("lines").cast("long").alias("n_turns"), "copies", rendered.alias("rendered"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


SQL = {
    "op4_chat_collapse": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, k, n, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t),
kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS copies FROM p
  WHERE k = n AND prefix NOT IN (SELECT prefix FROM p WHERE k < n) GROUP BY prefix)
SELECT t.conv_id, (k - 1) // 512 AS part, count(*) AS n_turns, copies,
       string_agg('<|' || replace(role, '|>', '') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY k) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY t.conv_id, part, copies"""
}
QUERIES = {"op4_chat_collapse": op4_chat_collapse}
