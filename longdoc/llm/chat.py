"""Operator 7, chat formatting by multi-party perspective rotation.

Every participant of a dialogue gets a rendering of it in which their own turns
are the assistant's, those of all others are turns of named users and system turns stay
the system's. Only the assistant's words bear loss. All of it is DataFrame code: the
turns are gathered in parts of ``PART_TURNS`` turn numbers. Those rows of a part (null or repeated turn
numbers and rows without a conv_id make more) are cut into pieces of ``PART_TURNS`` rows, and a piece of long turns into slices of
``PIECE_BYTES`` bytes, so nothing grows with its dialogue. Each slice is joined with the distinct speakers of the whole
dialogue (broadcast only while they are counted as few) and rendered for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longdoc.llm.common import BROADCAST_IDS, materialize
from longdoc.operators.batches import global_rank

#: Turn numbers of one part of a rendering, and rows of one piece of a part.
PART_TURNS = 256
#: Bytes of text of one slice, not counting its last turn.
PIECE_BYTES = 16 << 20
SYSTEM = "system"
#: Speaker of a turn without a role; it is nobody's perspective.
NOBODY = "unknown"

# fixed values: the marks of a rendered turn
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _clean(text: Column) -> Column:
    """A turn can't forge marks: those in its text lose their bars."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<$1>")


def _shown(x: Column, perspective: Column) -> Column:
    """A turn as ``perspective`` sees it: struct(role, head, body)."""
    role = (F.when(x["speaker"] == perspective, F.lit("assistant"))
            .when(x["speaker"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user")))
    named = (x["speaker"] != perspective) & ~x["speaker"].isin(SYSTEM, NOBODY)
    head = F.concat(F.lit(BEGIN), role, F.when(named, F.concat(F.lit(" name="), x["speaker"])).otherwise(F.lit("")), F.lit(MIDDLE))
    return F.struct(role.alias("role"), head.alias("head"), x["body"].alias("body"))


def _pieces(own: DataFrame, part_turns: int, piece_bytes: int) -> DataFrame:
    """Add ``piece``, the number of the row in its part in the order of turn, speaker and body by ``part_turns``, and
    ``slice``, the bytes before it in its piece by ``piece_bytes``. Both are 0 in parts that are small enough; only the
    rows of others are ranked."""
    sizes = own.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body")).alias("bytes"))
    large = sizes.where((F.col("n") > part_turns) | (F.col("bytes") > piece_bytes))
    crowded = materialize(large.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.lit(True).alias("_crowded")), "crowded")
    n = crowded.count()
    zero = F.lit(0).cast("long")
    if not n:
        return own.withColumn("piece", zero).withColumn("slice", zero)
    marked = own.join(F.broadcast(crowded) if n <= BROADCAST_IDS else crowded,
                      F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left")
    ranked = global_rank(marked.where("_crowded").select(*own.columns), ["conv_id", "part"], ["turn", "speaker", "body"], out="_at")
    ranked = ranked.withColumn("piece", F.floor((F.col("_at") - 1) / part_turns).cast("long"))
    before = Window.partitionBy("conv_id", "part", "piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    bytes_before = F.coalesce(F.sum(F.octet_length("body")).over(before), zero)
    return marked.where("_crowded is null").select(*own.columns, zero.alias("piece"), zero.alias("slice")).unionByName(
        ranked.select(*own.columns, "piece", F.floor(bytes_before / piece_bytes).cast("long").alias("slice")))


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           part_turns: int = PART_TURNS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Renderings: conv_id, perspective, part, piece, slice, n_turns, rendered (string), masks
    (array<struct<start,length>>: the code points of ``rendered`` that bear loss, a turn's
    body with its end mark).

    Turns are in the order of turn, then speaker, then text; part p has the turn
    numbers from p * part_turns on, of each part_turns rows a piece, numbered from 0, and the turns of a piece that
    begin in its i-th piece_bytes bytes of text the slice i. Their renderings follow each other. Null: a turn number sorts first, in part -1; a
    role is an unnamed user; a text is empty; a conv_id is a dialogue of its own.
    Repeated rows are turns each. A dialogue without a participant (system turns
    only) and an empty table give no row. Other columns are not read.
    """
    own = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit(NOBODY)).alias("speaker"),
                       _clean(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    own = _pieces(own.withColumn("part", part), part_turns, piece_bytes)
    parts = own.groupBy("conv_id", "part", "piece", "slice").agg(
        F.array_sort(F.collect_list(F.struct("turn", "speaker", "body"))).alias("t"))
    speakers = materialize(own.where(~F.col("speaker").isin(SYSTEM, NOBODY))
                           .select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct(), "speakers")
    if speakers.count() <= BROADCAST_IDS:
        speakers = F.broadcast(speakers)
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn(
        "t", F.transform("t", lambda x: _shown(x, F.col("perspective"))))
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    # one pass over the turns: the length so far, and a mask for each turn of the assistant's
    none = F.array().cast("array<struct<start:int,length:int>>")

    def add(acc: Column, x: Column) -> Column:
        head, length = F.char_length(x["head"]), F.char_length(x["body"]) + len(END) - 1
        mask = F.when(x["role"] == "assistant", F.array(F.struct((acc["at"] + head).alias("start"), length.alias("length")))).otherwise(none)
        return F.struct((acc["at"] + head + length + 1).alias("at"), F.concat(acc["masks"], mask).alias("masks"))

    return seen.select("conv_id", "perspective", "part", "piece", "slice", F.size("t").alias("n_turns"),
                       F.array_join(F.transform("t", whole), "").alias("rendered"),
                       F.aggregate("t", F.struct(F.lit(0).alias("at"), none.alias("masks")), add)["masks"].alias("masks"))


def digest(rendered: DataFrame) -> DataFrame:
    """Scalar columns of ``render``'s rows: md5 of the text, and of its masks as
    ``start:length`` joined by a comma."""
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["length"].cast("string"))), ",")
    return rendered.select("conv_id", "perspective", "part", "piece", "slice", F.col("n_turns").cast("long").alias("n_turns"),
                           F.char_length("rendered").cast("long").alias("n_chars"),
                           F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"), F.md5(spans.cast("binary")).alias("masks_md5"),
                           F.coalesce(F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + m["length"]),
                                      F.lit(0)).cast("long").alias("loss_chars"))


#: ``digest(render(conversations))`` for DuckDB.
SQL = """
WITH read AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker,
         regexp_replace(coalesce(text, ''), '<\\|(im_start|im_end)\\|>', '<\\1>', 'g') AS body
  FROM conversations),
ranked AS (SELECT *, coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS part, (row_number() OVER (
             PARTITION BY conv_id, coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) ORDER BY turn NULLS FIRST, speaker, body) - 1) AS at_
           FROM read),
own AS (SELECT *, at_ // 256 AS piece, CAST(coalesce(sum(strlen(body)) OVER (PARTITION BY conv_id, part, at_ // 256
          ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 16777216 AS slice FROM ranked),
speakers AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM own WHERE speaker NOT IN ('system', 'unknown')),
turns AS (
  SELECT conv_id, perspective, part, piece, slice, at_, speaker, body,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM own JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
pieces AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' AND speaker <> 'unknown' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM turns),
placed AS (
  SELECT *, length(head) AS n_head, length(body) + 10 AS n_own,
         coalesce(sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, perspective, part, piece, slice
           ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM pieces)
SELECT conv_id, perspective, part, piece, slice, count(*) AS n_turns, CAST(sum(n_head + n_own + 1) AS BIGINT) AS n_chars,
       md5(string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY at_)) AS rendered_md5,
       md5(coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(pos + n_head AS BIGINT) || ':' || n_own END, ',' ORDER BY at_), '')) AS masks_md5,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN n_own END), 0) AS BIGINT) AS loss_chars
FROM placed GROUP BY conv_id, perspective, part, piece, slice
"""
