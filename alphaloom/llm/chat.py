"""Chat formatting: logged snapshots of a growing conversation collapse into the longest, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alphaloom.llm.common import table

#: (from, to), in this order, in roles and texts: neither mark of the template is left, and a backslash tells what stood there. Roles hold no line break either.
ESCAPES = (("\\", "\\\\"), ("<|", "<\\|"), ("|>", "|\\>"))
LINE_BREAK = ("\n", "\\n")


def _escaped(c: Column, *more: tuple[str, str]) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (*ESCAPES, *more):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn of the template; different (role, text) render differently, null counting as empty."""
    return F.concat(F.lit("<|"), _escaped(role, LINE_BREAK), F.lit("|>\n"), _escaped(text), F.lit("\n<|end|>\n"))


def _digest(c: Column) -> Column:
    return F.md5(F.coalesce(c, F.lit("")))


def _turns(turns: DataFrame) -> DataFrame:
    """conv, turn, role, digest of the turns: what order and comparison need, without the texts."""
    return turns.select(F.col("conv_id").alias("conv"), "turn", "role", _digest(F.col("text")).alias("digest"))


def _hashes(index: Column) -> list[Column]:
    """Two hashes of a turn at its place. Columns are hashed one after the other, so that no two splits of the same letters meet; a null role counts as empty."""
    return [F.xxhash64(F.lit(salt), index, F.coalesce("role", F.lit("")), F.col("digest")) for salt in (1, 2)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv, i (from 1), n, h1 and h2: rolling hashes of a conversation's turns so far, 128 bits, by exclusive or of hashes of (place, role, text). Of turns with conv_id."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "digest")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _turns(turns.filter(F.col("conv_id").isNotNull())).withColumn("i", F.row_number().over(order).cast("long"))
    a, b = _hashes(F.col("i"))
    rows = rows.withColumns({"a": a, "b": b})
    return rows.select("conv", "i", F.bit_xor("a").over(so_far).alias("h1"), F.bit_xor("b").over(so_far).alias("h2"), F.count(F.lit(1)).over(Window.partitionBy("conv")).alias("n"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations with exactly these turns), chat: those that are no proper prefix of another.

    Turns are ordered by turn and role, nulls first, and then by the md5 of the text, and compared by role and text, null counting as empty. Of equal conversations the least
    conv_id stays, a null one only if there is no other. A turn without conv_id is a conversation of its own. Repeated rows are turns of their own. An empty table gives no
    rows; other columns are left out. A conversation is one row of the result, so that one task must hold it.

    Texts are shuffled once, and only those of the conversations that stay: order and comparison go by digests. Equal conversations and equal prefixes are each reduced to
    one row by partial aggregation before the anti-join, so that neither side has a hot key; turns without conv_id never meet in a window.
    """
    rows = prefix_hashes(turns)
    one, two = _hashes(F.lit(1).cast("long"))
    lone = turns.filter(F.col("conv_id").isNull()).select("role", "text", _digest(F.col("text")).alias("digest")).withColumns({"h1": one, "h2": two})
    first = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lone = lone.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_copies"), F.min(first).alias("said"))
    full = rows.filter("i = n").groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    both = full.select("n", "h1", "h2", "conv", "n_copies", F.lit(None).cast(lone.schema["said"].dataType).alias("said")).unionAll(lone.select(F.lit(1).cast("long"), "h1", "h2", F.lit(None).cast(turns.schema["conv_id"].dataType), "n_copies", "said"))
    both = both.groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv"), F.sum("n_copies").alias("n_copies"), F.first("said", ignorenulls=True).alias("said"))
    proper = rows.filter("i < n").select(F.col("i").alias("n"), "h1", "h2").distinct()
    kept = both.join(proper, ["n", "h1", "h2"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_copies", "said")
    alone = kept.filter(F.col("conv").isNull()).select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", rendered_turn(F.col("said.role"), F.col("said.text")).alias("chat"))
    texts = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text").join(kept.filter(F.col("conv").isNotNull()).drop("said"), "conv")
    turn = F.struct(F.col("turn").alias("a"), F.col("role").alias("b"), _digest(F.col("text")).alias("c"), rendered_turn(F.col("role"), F.col("text")).alias("t"))
    chat = F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]), "")
    named = texts.groupBy("conv", "n_turns", "n_copies").agg(chat.alias("chat")).withColumnRenamed("conv", "conv_id")
    return named.unionAll(alone)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(table(spark, sf_dir, "conversations"))


def _sql_escaped(c: str, *more: tuple[str, str]) -> str:
    out = f"coalesce({c}, '')"
    for a, b in (*ESCAPES, *more):
        out = f"replace({out}, {'chr(10)' if a == LINE_BREAK[0] else repr(a).replace(chr(92) * 2, chr(92))}, {repr(b).replace(chr(92) * 2, chr(92))})"
    return out


ORACLE_SQL = f"""
WITH turns AS (
  SELECT coalesce(conv_id::VARCHAR, 'none ' || row_number() OVER ()) AS c, conv_id, turn, role, md5(coalesce(text, '')) AS d,
    '<|' || {_sql_escaped("role", LINE_BREAK)} || '|>' || chr(10) || {_sql_escaped("text")} || chr(10) || '<|end|>' || chr(10) AS t
  FROM conversations),
placed AS (SELECT c, conv_id, t, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role NULLS FIRST, d) AS i, count(*) OVER (PARTITION BY c) AS n FROM turns),
prefixes AS (SELECT c, conv_id, i, n, string_agg(t, '') OVER (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM placed),
full_ AS (SELECT n, p, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE i = n GROUP BY n, p)
SELECT conv_id, n AS n_turns, n_copies, p AS chat FROM full_
WHERE NOT EXISTS (SELECT 1 FROM prefixes x WHERE x.i = full_.n AND x.n > full_.n AND x.p = full_.p)"""
