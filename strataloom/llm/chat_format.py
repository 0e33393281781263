"""Operator 9, chat formatting of preference pairs: one shared prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import table

#: What stands before and behind a turn's text; the header names the role.
HEADER, FOOTER = ("<|", "|>\n"), "<|end|>\n"


def preference_pairs(turns: DataFrame, pair_col: str = "pair_id", chosen_col: str = "chosen", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of preference pairs: pair_id, part, turn, role, rendered, n_chars, loss_from, loss_to.

    turns holds the turns of both conversations of each pair, `chosen` telling them apart. The longest common prefix
    of turns (same number, role and text) is the part `prompt`, rendered once; what follows is the part `chosen`
    and the part `rejected`. In the order of part and turn the segments of a part, put together, are its text.
    rendered[loss_from : loss_to] (code points, from 0) carries loss: text and end mark of an assistant's turn in a
    completion; elsewhere both are null.

    A pair with one conversation alone has an empty prompt and one completion; equal conversations have a prompt
    only. Rows that repeat count once. Several different texts under one turn all stay, in the order of role and
    text, and a turn is common only if both sides hold the same. Null texts render as empty, a null role as
    `unknown`; null turns never belong to the prompt; null pair ids form one pair; a null `chosen` counts as rejected.
    Ids and turns may have any type that orders; long texts are one value of one row; other columns are ignored,
    whatever their names; an empty table gives no segments.

    Two hash aggregations and one equi-join by pair; a row stays a turn, so no conversation is gathered.
    """
    rows = turns.select(F.col(pair_col).alias("pair"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.coalesce(F.col(chosen_col), F.lit(False)).alias("chosen"))
    both = rows.groupBy("pair", "turn", "role", "text").agg(F.bool_or("chosen").alias("c"), F.bool_or(~F.col("chosen")).alias("r"))
    differ = both.groupBy(F.col("pair").alias("of")).agg(F.min(F.when(~(F.col("c") & F.col("r")), F.col("turn"))).alias("differ"))
    placed = both.join(differ, F.col("pair").eqNullSafe(F.col("of")))
    common = F.col("c") & F.col("r") & F.col("turn").isNotNull() & (F.col("differ").isNull() | (F.col("turn") < F.col("differ")))
    side = lambda flag, name: F.when(F.col(flag), F.lit(name))
    parts = F.when(common, F.array(F.lit("prompt"))).otherwise(F.array_compact(F.array(side("c", "chosen"), side("r", "rejected"))))
    out = placed.withColumn("part", F.explode(parts))
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    header = F.concat(F.lit(HEADER[0]), role, F.lit(HEADER[1]))
    rendered = F.concat(header, text, F.lit(FOOTER))
    loss = (F.col("part") != "prompt") & (role == "assistant")
    return out.select(
        F.col("pair").alias("pair_id"), "part", "turn", role.alias("role"), rendered.alias("rendered"), F.length(rendered).cast("long").alias("n_chars"),
        F.when(loss, F.length(header).cast("long")).alias("loss_from"), F.when(loss, F.length(rendered).cast("long")).alias("loss_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) form pair k."""
    turns = table(spark, sf_dir, "conversations")
    return preference_pairs(turns.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod(F.col("conv_id"), F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"))


ORACLE = """
WITH t AS (SELECT floor(conv_id / 2)::bigint AS pair, turn, role, text, bool_or(conv_id % 2 = 0) AS c, bool_or(conv_id % 2 <> 0) AS r FROM conversations GROUP BY ALL),
d AS (SELECT *, min(CASE WHEN NOT (c AND r) THEN turn END) OVER (PARTITION BY pair) AS differ FROM t),
p AS (SELECT *, c AND r AND turn IS NOT NULL AND (differ IS NULL OR turn < differ) AS common FROM d),
s AS (SELECT *, unnest(CASE WHEN common THEN ['prompt'] ELSE list_filter([CASE WHEN c THEN 'chosen' END, CASE WHEN r THEN 'rejected' END], lambda x: x IS NOT NULL) END) AS part FROM p),
h AS (SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS header FROM s),
e AS (SELECT *, header || coalesce(text, '') || '<|end|>' || chr(10) AS rendered, part <> 'prompt' AND coalesce(role, 'unknown') = 'assistant' AS loss FROM h)
SELECT pair AS pair_id, part, turn, coalesce(role, 'unknown') AS role, rendered, length(rendered)::bigint AS n_chars, CASE WHEN loss THEN length(header)::bigint END AS loss_from, CASE WHEN loss THEN length(rendered)::bigint END AS loss_to FROM e"""
