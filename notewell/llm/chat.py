"""Chat formatting of reply trees.

Messages form trees by their parent. Self-joins that double their reach find each node's
root, depth and path score; the best leaf of each tree is chosen; the same doubled links,
walked down again, give the nodes of its path, which become one conversation.

Template, for each turn: ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed.
Inside roles and texts every ``<``, then any backslashes, then ``|`` gets one backslash more before the
bar, so that no control string is left; a role's backslashes and line feeds are escaped before that. Both are
undone exactly on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_position

START, END = "<|im_start|>", "<|im_end|>"
#: Turns that are joined into one piece before pieces are joined.
PIECE = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Takes the halves of a doubled backslash apart from those before an n."""
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def reply_chain(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations as trees: (msg_id, parent_id, conv_id, role, text, score).

    A row replies to the row before it in (turn, role, text) order, null first. Positions in that order
    serve as message ids; a row number splits repeated rows.
    """
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("_same", F.monotonically_increasing_id()).checkpoint()
    placed = with_position(rows, [F.col(c) for c in ("conv_id", "turn", "role", "text", "_same")], "msg_id")
    first = placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("msg_id").alias("_first"))
    parent = F.when(F.col("msg_id") > F.col("_first"), F.col("msg_id") - 1)
    return placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "msg_id", parent.alias("parent_id"), "conv_id", "role", "text", F.lit(1.0).alias("score"))


def best_paths(messages: DataFrame) -> DataFrame:
    """(root_id, msg_id, up): the nodes on each tree's best root-to-leaf path, ``up`` steps above its leaf.

    ``messages`` has msg_id (not null), parent_id (null: a root) and score. A path's score is the
    mean of its messages' scores, a null counting 0; ties go to the smaller leaf id. Rounds grow
    with the logarithm of the depth. A node whose parent is missing is left out, with all below it.
    """
    nodes = messages.select("msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score")).checkpoint()
    # after k rounds `to` is the ancestor 2^k steps up, or the root where the walk has ended before
    rooted = F.col("parent_id").isNull()
    walk = nodes.select(
        "msg_id", F.coalesce("parent_id", "msg_id").alias("to"), (~rooted).cast("long").alias("depth"),
        F.when(rooted, 0.0).otherwise(F.col("score")).alias("total"), rooted.alias("ended")).checkpoint()
    done, going = walk.where("ended"), walk.where("NOT ended")
    links = []
    while not going.isEmpty():
        links.append(going.select("msg_id", "to"))
        far = done.union(going).select(
            F.col("msg_id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("d2"), F.col("total").alias("t2"), "ended")
        # only walks that have not ended go on, so a round costs what is left of the deep trees
        ahead = going.drop("ended").join(far, "to").select(
            "msg_id", F.col("next").alias("to"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"), "ended").checkpoint()
        done, going = done.union(ahead.where("ended")), ahead.where("NOT ended")
    walk = done.checkpoint()
    roots = nodes.where("parent_id IS NULL").select(F.col("msg_id").alias("to"), F.col("score").alias("root_score"))
    leaves = walk.join(nodes.select(F.col("parent_id").alias("msg_id")), "msg_id", "left_anti").join(roots, "to")
    mean = (F.col("total") + F.col("root_score")) / (F.col("depth") + 1)
    best = leaves.groupBy(F.col("to").alias("root_id")).agg(
        F.max_by("msg_id", F.struct(mean, -F.col("msg_id"))).alias("msg_id"))
    path = best.withColumn("up", F.lit(0).cast("long")).checkpoint()
    for k, link in reversed(list(enumerate(links))):
        higher = path.join(link, "msg_id").select("root_id", F.col("to").alias("msg_id"), (F.col("up") + (1 << k)).alias("up"))
        path = path.union(higher).checkpoint()
    return path


def format_paths(messages: DataFrame, path: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_turns) for each path; null roles and texts are empty.

    ``loss_turns`` is the loss mask: for each turn, whether its text is trained on (role assistant).
    Turns are joined in pieces of PIECE first, so that a long conversation is not gathered
    message by message in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))
    rows = path.join(messages, "msg_id").select(
        "root_id", "conv_id", "up", turn.alias("turn"), (role == "assistant").alias("loss"))

    def ordered(column: str) -> Column:
        # a list of structs sorts by `up`, which falls along the path
        return F.sort_array(F.collect_list(F.struct("up", *column.split())), asc=False)

    pieces = rows.groupBy("root_id", "conv_id", (F.floor(F.col("up") / PIECE)).alias("_piece")).agg(
        ordered("turn loss").alias("t"))
    pieces = pieces.select(
        "root_id", "conv_id", F.col("_piece").alias("up"),
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("turn"),
        F.transform("t", lambda x: x["loss"]).alias("loss"))
    return pieces.groupBy("root_id", "conv_id").agg(ordered("turn loss").alias("t")).select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda x: x["loss"])).alias("loss_turns"))


def format_chat(rows: DataFrame) -> DataFrame:
    """One formatted conversation per conv_id of (conv_id, turn, role, text) rows.

    Every row is a turn, repeated ones too; a null conv_id is a conversation; an empty table gives no
    rows; other columns are ignored.
    """
    messages = reply_chain(rows).checkpoint()
    return format_paths(messages, best_paths(messages))


def parse(formatted: DataFrame) -> DataFrame:
    """Read ``format_chat`` output back: adds turns, an array of (role, text, loss)."""
    ends = F.split("formatted", r"<\|im_end\|>\n")
    bodies = F.slice(ends, F.lit(1), F.size(ends) - 1)

    def turn(body: Column, i: Column) -> Column:
        inner = F.substr(body, F.lit(len(START) + 1))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(
            unescape_role(role).alias("role"), unescape(F.substr(inner, F.length(role) + 2)).alias("text"),
            F.element_at("loss_turns", (i + 1).cast("int")).alias("loss"))

    return formatted.withColumn("turns", F.transform(bodies, turn))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS loss_sha256,
       sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g'))
              + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
