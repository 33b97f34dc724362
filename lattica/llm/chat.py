"""Conversations from reply trees.

Iterative self-joins by doubling sum up the scores on every root-to-leaf path,
branches are ranked by that sum, the same tables of ancestors list the chosen
paths, and each becomes one text in a chat template.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import NO_ID, cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Makes control strings harmless: ``~`` becomes ``~0`` and ``<|`` becomes ``~1``, so no escaped text holds ``<|``."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescape(text: Column) -> Column:
    """Undoes :func:`escape`."""
    return F.replace(F.replace(text, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~2"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~2"), F.lit("\n")))


def climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The sum of the scores from each node up to its root (tree, node, total, leaf), and tables of ancestors 2**k steps above (tree, node, up).

    ``messages`` has tree, node, parent, score.  A parent that isn't there
    makes a root.  Round k joins the table of round k - 1 with itself, one row
    for each node that has not reached its root, so paths of m messages take
    log2(m) rounds, of which only long paths see the later ones.
    Nodes whose way up runs into a circle have no root and are left out.
    """
    own = messages.select("tree", "node", "parent", "score")
    parents = own.select("tree", F.col("parent").alias("up")).where("up is not null").distinct()
    real = parents.join(own.select("tree", F.col("node").alias("up")), ["tree", "up"], "left_semi").withColumn("leads", F.lit(True))
    state = own.withColumnRenamed("parent", "up").join(real, ["tree", "up"], "left").select("tree", "node", F.when(F.col("leads"), F.col("up")).alias("up"), "score")
    led = real.select("tree", F.col("up").alias("node"), F.col("leads").alias("led"))
    state = cut(state.join(led, ["tree", "node"], "left").select("tree", "node", "up", F.col("score").alias("total"), F.col("led").isNull().alias("leaf")))
    most = own.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    done, tables, step = [], [], 1
    while True:
        # nodes that have reached their root are left alone from here on
        done.append(state.where("up is null"))
        going = state.where("up is not null")
        if step >= 2 * most or going.isEmpty():
            return reduce(DataFrame.unionByName, [x.select("tree", "node", "total", "leaf") for x in done]), tables
        tables.append(going.select("tree", "node", "up"))
        every = reduce(DataFrame.unionByName, [*done, going])
        above = every.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("total").alias("more"))
        joined = going.join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
        state = cut(joined.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), "leaf"))
        step *= 2


def ways(best: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree, leaf, rank, node, distance) for each node on the way up from the given leaves (tree, leaf, rank).

    Round k appends the nodes 2**k .. 2**(k + 1) - 1 steps above; what is
    there already is not written again.
    """
    rounds = [cut(best.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("distance")))]
    for k, jump in enumerate(tables):
        found = reduce(DataFrame.unionByName, rounds)
        rounds.append(cut(found.join(jump, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("distance") + (1 << k)).alias("distance"))))
    return reduce(DataFrame.unionByName, rounds)


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One formatted conversation for each of the ``branches`` best branches of each tree.

    ``messages`` has tree (long), node (long), parent (long, null at a root),
    role, text, score (double).  Branches are ranked by the sum of their
    scores before any path is listed.  Returns tree, leaf, rank, formatted and
    loss_spans: start and end (code points, end exclusive) of the escaped
    assistant texts in formatted.  Null roles, texts and scores count as
    empty and 0; texts of any length stay whole; a null tree is a tree of its
    own; messages without node are left out, and of messages that share a node
    the one whose role, text and score sort last counts; ties between branches
    go to the smaller leaf; other columns, whatever their names, are ignored;
    an empty table gives an empty result.
    """
    m = messages.where(F.col("node").isNotNull()).select(F.coalesce("tree", F.lit(NO_ID)).alias("tree"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    m = cut(m.groupBy("tree", "node").agg(F.max(F.struct("role", "text", "score", "parent")).alias("x")).select("tree", "node", "x.*"))
    scored, tables = climb(m)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    best = scored.where("leaf").select("tree", F.col("node").alias("leaf"), rank.alias("rank")).where(F.col("rank") <= branches)
    piece = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    rows = ways(best, tables).join(m.select("tree", "node", "role", "text"), ["tree", "node"])
    rows = rows.select("tree", "leaf", "rank", (-F.col("distance")).alias("at"), "role", piece.alias("piece"), F.length(_role(F.col("role"))).alias("role_size"))
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(START) + F.col("role_size") + 1
    rows = rows.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length("piece") - len(START) - F.col("role_size") - 1 - len(END) - 1)
    span = F.when(F.col("role") == "assistant", F.struct(F.col("begin").alias("start"), "end"))
    out = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return out.select(F.nullif("tree", F.lit(NO_ID)).alias("tree"), "leaf", "rank", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "loss_spans")


def read_back(chats: DataFrame) -> DataFrame:
    """The turns (array of role and text) and the text under the loss mask, parsed from formatted and loss_spans alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turn(p: Column) -> Column:
        nl = F.instr(p, F.lit("\n"))
        body = F.substr(p, nl + 1, F.length(p) - nl - len(END) - 1)
        return F.struct(_unrole(F.substr(p, F.lit(1), nl - 1)).alias("role"), unescape(body).alias("text"))

    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return chats.withColumns({"turns": F.transform(pieces, turn), "masked": masked})


def linear(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Messages of conversations without branches: each turn answers the one before it; turns that tie go by role and text."""
    by = Window.partitionBy(id_col).orderBy(F.col(turn_col).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(by).cast("long")
    return rows.select(F.col(id_col).cast("long").alias("tree"), node.alias("node"), "role", "text").withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


ORACLE = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2'))
                + length(replace(replace(text, '~', '~0'), '<|', '~1'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
