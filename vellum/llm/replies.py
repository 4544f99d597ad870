"""Reply trees as training conversations: root-to-leaf paths, ranked branches, one formatted text a path.

DataFrame functions only. Jumps of 1, 2, 4, ... messages up are self-joins of the table before, so a tree of depth d takes
log2(d) rounds; each round is written to the shared folder. They give every leaf its root, its depth and its score; the chosen
leaves collect the messages above them by the same jumps from the longest to the shortest, so no message is visited that is on no
chosen path. A message with very many replies is a hot key of these joins: such keys are met by broadcast of a bounded number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import spread_join, stored

#: Marks of the template. A text holds no "<" once it is escaped, so neither mark can occur in it.
OPEN, CLOSE = "<turn ", "</turn>\n"


def escaped(c: Column) -> Column:
    """c without <, > and bare &; the order of the replacements makes it reversible."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def _nodes(messages: DataFrame, id_col: str, parent_col: str, role_col: str, text_col: str, score_col: str | None, tree_col: str | None) -> DataFrame:
    """node, up, role, text, score, tree; one row per id, up null where the parent is not there."""
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    score = F.when(F.isnan(score), 0.0).otherwise(score)
    tree = F.col(tree_col) if tree_col else F.lit(None).cast("string")
    body = F.struct(F.col(parent_col).cast("string").alias("up"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), score.alias("score"), tree.alias("tree"))
    named = F.concat(F.lit("="), F.col(id_col).cast("string"))
    nameless = F.concat(F.lit("#"), F.sha2(F.to_json(body), 256))
    rows = messages.select(F.coalesce(named, nameless).alias("node"), body.alias("body"))
    rows = rows.groupBy("node").agg(F.min("body").alias("body")).select("node", "body.*")
    return rows.withColumn("up", F.concat(F.lit("="), F.col("up")))


def _followed(rows: DataFrame, jumps: DataFrame, key: str, total: int) -> DataFrame:
    """rows with further and more, the up and sum of the jump that begins at their key; key may be hot in rows, node is unique in jumps."""
    asked = rows.groupBy(key).agg(F.count("*").alias("asked"))
    keyed = asked.join(jumps.select(F.col("node").alias(key), F.col("up").alias("further"), F.col("sum").alias("more")), key)
    return spread_join(rows, keyed, key, "asked", total)


def paths(
    messages: DataFrame,
    *,
    id_col: str = "msg_id",
    parent_col: str = "parent_id",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = "score",
    tree_col: str | None = None,
    per_tree: int | None = 1,
) -> DataFrame:
    """leaf, root, tree, rank, depth, score, at, role, text: one row for each message of each chosen root-to-leaf path, at counts from 0.

    The score of a branch is the mean of its messages' scores (null and NaN: 0); of each root the per_tree best branches are
    chosen (all if None), rank 1 the best, ties to the shorter and then the smaller leaf id. tree is the root's tree_col.
    Copies of an id count once (the smallest parent, role, text); a message without an id has no replies; a parent that is null
    or not there makes a root. Messages that answer each other in a circle, and what hangs from them, are on no path from a
    root and are left out. An empty table gives an empty one.
    """
    nodes = stored(_nodes(messages, id_col, parent_col, role_col, text_col, score_col, tree_col), "replies")
    total = max(nodes.count(), 1)
    answers = nodes.where("up IS NOT NULL").select("node", "up", F.col("score").alias("sum"))
    parents = answers.groupBy("up").agg(F.count("*").alias("asked")).join(nodes.select(F.col("node").alias("up")), "up")
    jumps = [stored(spread_join(answers, parents, "up", "asked", total), "jumps")]
    # ends: a node, its root, its depth and the scores below the root; after round k all nodes of a depth under 2^(k+1)
    roots = nodes.join(jumps[0].select("node"), "node", "left_anti")
    ends = stored(roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(0.0).alias("sum")), "ends")
    for k in range(total.bit_length() + 1):
        step = jumps[k]
        if not step.head(1):
            break
        # whoever jumps onto a node with a known end gets one, too
        asked = step.groupBy("up").agg(F.count("*").alias("asked"))
        known = asked.join(ends.select(F.col("node").alias("up"), "root", "depth", F.col("sum").alias("more")), "up")
        found = spread_join(step, known, "up", "asked", total)
        ends = stored(ends.unionByName(found.select("node", "root", (F.col("depth") + (1 << k)).alias("depth"), (F.col("sum") + F.col("more")).alias("sum"))), "ends")
        far = _followed(step, step, "up", total)
        jumps.append(stored(far.select("node", F.col("further").alias("up"), (F.col("sum") + F.col("more")).alias("sum")), "jumps"))
    replied = parents.select(F.col("up").alias("node"))
    own = nodes.select(F.col("node").alias("root"), F.col("tree"), F.col("score").alias("root_score"))
    leaves = ends.join(replied, "node", "left_anti")
    scored = leaves.join(own, "root").select(F.col("node").alias("leaf"), "root", "tree", "depth", ((F.col("sum") + F.col("root_score")) / (F.col("depth") + 1)).alias("score"))
    best = [F.col("score").desc(), F.col("depth"), F.col("leaf")]
    if per_tree is not None:
        # in two levels, so that a tree of very many leaves is not ranked by one task
        salted = scored.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(256))).withColumn("rank", F.row_number().over(W.partitionBy("root", "salt").orderBy(*best)))
        scored = salted.where(F.col("rank") <= per_tree).drop("salt")
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("root").orderBy(*best))).where(F.col("rank") <= per_tree)
    else:
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("root").orderBy(*best)))
    chosen = stored(ranked, "chosen")

    # from the longest jump to the shortest: every message above a leaf is one sum of different powers of two away
    members = stored(chosen.select("leaf", F.col("leaf").alias("node"), F.col("depth").alias("at")), "members")
    for k in reversed(range(len(jumps))):
        above = _followed(members, jumps[k], "node", total)
        members = stored(members.unionByName(above.select("leaf", F.col("further").alias("node"), (F.col("at") - (1 << k)).alias("at"))), "members")
    used = members.groupBy("node").agg(F.count("*").alias("asked")).join(nodes.select("node", "role", "text"), "node")
    rows = spread_join(members, used, "node", "asked", max(members.count(), 1))
    return rows.drop("node").join(chosen, "leaf").select(_bare("leaf"), _bare("root"), "tree", "rank", "depth", "score", "at", "role", "text")


def _bare(name: str) -> Column:
    return F.when(F.col(name).startswith("="), F.expr(f"substring({name}, 2)")).otherwise(F.col(name)).alias(name)


def formatted(rows: DataFrame, key: list[str], *, at: str = "at", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """key, conversation, loss: the rows of a key in the order of `at` as one text, and which of its places count in the loss.

    A turn is "<turn ROLE>TEXT</turn>\\n" with ROLE and TEXT escaped; nulls are empty. loss has a struct for each turn of the
    role `learned`: turn (from 0), start and end (code points of the conversation, end exclusive) and head, how far the text
    is from the turn's begin. Rows at the same place are ordered by role, then text.
    """
    who, what = escaped(F.coalesce(F.col(role).cast("string"), F.lit(""))), escaped(F.coalesce(F.col(text).cast("string"), F.lit("")))
    turns = rows.select(*key, F.col(at).alias("at"), F.concat(F.lit(OPEN), who, F.lit(">")).alias("head"), what.alias("body"), F.coalesce(F.col(role) == learned, F.lit(False)).alias("counts"))
    turns = turns.select(*key, "at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.char_length("head").alias("head"), F.char_length("body").alias("size"), "counts")
    order = W.partitionBy(*key).orderBy("at", "piece")
    before = F.sum(F.char_length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    turns = turns.withColumns({"nth": F.row_number().over(order), "begin": F.coalesce(before, F.lit(0)) + F.col("head")})
    span = F.struct((F.col("nth") - 1).alias("turn"), F.col("begin").alias("start"), (F.col("begin") + F.col("size")).alias("end"), F.col("head").alias("head"))
    all_turns = F.sort_array(F.collect_list(F.struct("nth", "piece")))
    return turns.groupBy(*key).agg(
        F.array_join(F.transform(all_turns, lambda t: t["piece"]), "").alias("conversation"), F.sort_array(F.collect_list(F.when(F.col("counts"), span))).alias("loss")
    )


def pieces(conversation: Column) -> Column:
    """The turns of a formatted conversation, without their closing marks."""
    cut = F.split(conversation, CLOSE)
    return F.slice(cut, 1, F.size(cut) - 1)


def read_turns(conversation: Column) -> Column:
    """array of (role, text) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        head = F.instr(piece, ">")
        return F.struct(
            unescaped(F.substring(piece, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)).alias("role"), unescaped(F.substring(piece, head + 1, F.char_length(piece))).alias("text")
        )

    return F.transform(pieces(conversation), turn)


def read_loss(conversation: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped; each is cut out of its own turn."""
    cut = pieces(conversation)
    return F.transform(loss, lambda s: unescaped(F.substring(F.get(cut, s["turn"]), (s["head"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def digests(conversations: DataFrame, key: list[str]) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the conversations and their loss."""
    read = conversations.select(*key, read_turns(F.col("conversation")).alias("turns"), F.array_join(read_loss(F.col("conversation"), F.col("loss")), "").alias("answer"), F.char_length("conversation").alias("chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        *key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("answer").cast("long").alias("loss_chars"),
        F.sha2("answer", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id, msg_id, parent_id, role, text of conversations(conv_id, turn, role, text): each row answers the one before it.

    Rows of the same turn are ordered by role and text; null turns come first. Null conv_ids are one conversation.
    """
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("nth", at)
    name = lambda nth: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), nth.cast("string"))
    return rows.select("conv_id", name(F.col("nth")).alias("msg_id"), F.when(F.col("nth") > 1, name(F.col("nth") - 1)).alias("parent_id"), "role", "text")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: its only branch formatted, and what can be read back from that text."""
    chosen = paths(threads(conversations), score_col=None, tree_col="conv_id")
    out = digests(formatted(chosen, ["leaf", "tree"]), ["leaf", "tree"])
    return out.withColumn("conv_id", F.col("tree")).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
