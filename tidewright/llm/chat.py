"""Chat formatting: conversations logged again and again as they grew collapse to the longest, which is rendered.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.storage import written

OPEN, SHUT, END = "<|", "|>\n", "\n<|end|>\n"
#: What an opening mark inside a turn is written as, so that only rendering makes marks.
ESCAPED = "< |"


def _digest(salt: int, *columns: Column) -> Column:
    """A 64-bit hash that tells null from empty."""
    return F.xxhash64(F.lit(salt), *[x for c in columns for x in (c.isNull(), c)])


def listed(turns: DataFrame) -> DataFrame:
    """(conv_id, n, rendered, hashes): each conversation as one row, with a hash of each turn and its place.

    The one shuffle of texts. A conversation's turns are one row as its
    rendering is one string.
    """
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(OPEN), F.lit(ESCAPED))
    one = lambda t: F.concat(F.lit(OPEN), F.coalesce(F.nullif(F.lower(F.trim(clean(t["role"]))), F.lit("")), F.lit("unknown")), F.lit(SHUT), clean(t["text"]), F.lit(END))
    pair = lambda t, i: F.struct(*[_digest(salt, i, t["role"], t["text"]).alias(f"h{salt}") for salt in (1, 2)])
    return rows.select("conv_id", F.size("turns").cast("long").alias("n"), F.concat_ws("", F.transform("turns", one)).alias("rendered"), F.transform("turns", pair).alias("hashes"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, n, h1, h2): the hash of the first place turns, for each turn of each conversation.

    The hash of a prefix is the exclusive or of its turns' hashes, each of which
    holds the turn's place: a running aggregate over narrow rows.
    """
    turns = conversations.select("conv_id", "n", F.posexplode("hashes").alias("at", "h"))
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("conv_id", "n", (F.col("at") + 1).cast("long").alias("place"), *[F.bit_xor(f"h.h{salt}").over(so_far).alias(f"h{salt}") for salt in (1, 2)])


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that are no prefix of a longer one.

    Of conversations with equal turns the smallest conv_id stands for all, and
    copies says how many they are. Both sides of the anti-join have a hash once
    at most, so conversations that are logged very often make no hot key.
    """
    hashed = prefixes(conversations)
    whole = hashed.filter("place = n").select("conv_id", "n", "h1", "h2")
    proper = hashed.filter("place < n").select(F.col("place").alias("n"), "h1", "h2").distinct()
    once = whole.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return once.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and rendered for each maximal conversation of turns(conv_id, turn, role, text).

    Turns are in order of turn, then role, then text, nulls first; rows equal in
    all four columns are one turn. A null role is rendered as unknown and a null
    text as empty, but null and empty texts are different turns. Rows with a
    null conv_id form one conversation. A conversation of any length, and a turn
    of any length, is rendered whole: it is one row and one task's work. Other columns are ignored; no rows give
    no rows.
    """
    conversations = written(listed(turns), "conversations")
    kept = maximal(conversations).withColumnRenamed("conv_id", "of")
    return conversations.join(kept, conversations["conv_id"].eqNullSafe(kept["of"])).select("conv_id", "n_turns", "copies", "rendered")


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         md5(string_agg(md5(coalesce('=' || role, '-')) || md5(coalesce('=' || text, '-')), '') OVER w) AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kept AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS copies
  FROM p WHERE place = n AND NOT EXISTS (SELECT 1 FROM p AS q WHERE q.place < q.n AND q.place = p.n AND q.h = p.h)
  GROUP BY n, h)
SELECT kept.conv_id, n_turns, copies,
       string_agg('<|' || coalesce(nullif(lower(trim(replace(coalesce(role, ''), '<|', '< |'))), ''), 'unknown') || '|>' || chr(10)
                  || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10), ''
                  ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM kept JOIN t ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY ALL
"""
