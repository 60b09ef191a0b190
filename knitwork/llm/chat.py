"""Chat rendering after collapsing cumulative snapshots of the same conversation.

Loggers often save a conversation again after each turn, so that one is the
beginning of another. Each turn gets two 64-bit hashes of its place, role and
text; their running exclusive-or over a conversation's turns is a hash of that
prefix. A conversation whose full hash occurs as a proper prefix of another is
dropped by an anti join; of equal conversations the one with the smallest id
stays. All of it is DataFrame operations.

Turns are ordered by turn number, then role and text; the place of a turn is its
rank, so gaps in the numbers do not matter.

Defined cases: a null role or text differs from an empty one and renders as
empty; all rows with a null conversation id or turn belong to one conversation
or come first in it; repeated turns are turns of their own; very long texts are
hashed whole; an empty table gives an empty result; other columns are ignored,
whatever their names. A conversation becomes one row, so its turns meet in one
task in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One turn as rendered, and what stands between turns.
OPEN, CLOSE, BETWEEN = "<|", "|>\n", "\n"


def _null_mark(name: str) -> Column:
    return F.col(name).isNull()


#: A conversation, also one without an id: all steps deal rows by these two columns, so that a text moves to its conversation and stays there.
_WHOLE = ["nameless", "name"]


def _named(table: DataFrame) -> DataFrame:
    return table.withColumns({"nameless": F.col("conv_id").isNull(), "name": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation, its length, and the hash pair of the prefix that ends there."""
    order = W.partitionBy(*_WHOLE).orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = _named(turns.select("conv_id", "turn", "role", "text")).withColumn("place", F.row_number().over(order).cast("long"))
    content = ["place", _null_mark("role"), "role", _null_mark("text"), "text"]
    running = W.partitionBy(*_WHOLE).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    hashed = placed.withColumns({"h1": F.xxhash64(F.lit(1), *content), "h2": F.xxhash64(F.lit(2), *content, F.lit(3))})
    return hashed.withColumns({"p1": F.bit_xor("h1").over(running), "p2": F.bit_xor("h2").over(running), "n_turns": F.count("*").over(W.partitionBy(*_WHOLE))})


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that begin no longer one; the smallest id of equal ones."""
    whole = hashed.filter(F.col("place") == F.col("n_turns"))
    whole = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    begun = hashed.filter(F.col("place") < F.col("n_turns")).groupBy(F.col("place").alias("n_turns"), "p1", "p2").agg(F.lit(1).alias("one"))
    return whole.join(begun, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "n_logged")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged (equal conversations) and rendered text of each maximal conversation."""
    hashed = prefix_hashes(turns)
    shown = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE), F.coalesce("text", F.lit("")))
    lines = hashed.select(*_WHOLE, F.struct("place", shown.alias("shown")).alias("line"))
    joined = lines.join(_named(maximal(hashed)), _WHOLE)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["shown"]), BETWEEN)
    return joined.groupBy(*_WHOLE, "conv_id", "n_turns", "n_logged").agg(text.alias("rendered")).drop(*_WHOLE)
