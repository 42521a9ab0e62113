"""Reply trees to chat-formatted conversations, with DataFrame operations only.

``reply_paths`` finds every root-to-leaf path of every reply tree. It does not walk level by level:
self-joins build the ancestors at distance 1, 2, 4, ... of each message, and a second run of
self-joins unfolds each leaf into its path, doubling the known part each time. A tree of depth d thus
takes 2*log2(d) joins, and the rows made are those of the paths themselves.

``format_paths`` renders each path, ``read_back`` parses the rendered text again.

Defined results
* null text or role counts as empty; a null score as 0; a null tree id is a tree of its own.
* a message whose parent is absent (or null, or itself) is a root; messages on a cycle, or behind one,
  have no root and so are on no path.
* several messages with one (tree, node) id: the least (role, text) stays.
* extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpoint

#: What the template itself writes, and strings that well-known templates give a meaning.
BEGIN, HEAD, HEAD_END, TURN_END = "<s>", "<|", "|>\n", "</s>\n"
_CONTROL = r"(?s)(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\|(?=>))"


def escape(text: Column) -> Column:
    """Put a backslash inside each control string and double the backslashes there are."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, max_branches: int | None = None, max_paths: int | None = None) -> DataFrame:
    """messages(tree, node, parent, role, text, score) -> one row per message of each chosen path:
    tree, leaf, rank (of the path in its tree), pos (0 at the root), role, text.

    Branches are ranked among the replies to one message by score, then by node; max_branches keeps
    the best ones, and what answers a reply that is not kept goes with it. Paths are ranked in their tree by mean
    score, then by leaf; max_paths keeps the best, and only those are unfolded: lengths and sums of scores go
    along with the jumps, so a leaf is ranked by log2(d) rows and not by its whole path.

    The joins carry ids and scores; roles and texts are joined to the chosen paths once, at the end."""
    nodes = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("parent").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m")).select("tree", "node", "m.*")
    nodes = checkpoint(nodes)
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.lit(True).alias("known"))
    linked = nodes.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")) & ~F.col("parent").eqNullSafe(F.col("node")), "left")
    bare = linked.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score")
    if max_branches is not None:
        # roots stay; a reply beyond the best still has its parent, so what follows it finds no way to a root
        best = Window.partitionBy("tree", "up").orderBy(F.desc("score"), "node")
        bare = bare.withColumn("kept", F.col("up").isNull() | (F.row_number().over(best) <= max_branches))
    else:
        bare = bare.withColumn("kept", F.lit(True))
    bare = checkpoint(bare)
    kept = bare.where("kept")
    jumps = [kept.where("up is not null").select("tree", "node", "up")]
    # no path is longer than its tree has messages; only on a cycle would jumps go on for ever
    most = kept.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while 1 << len(jumps) < most:
        a, b = jumps[-1], jumps[-1].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("further"))
        nxt = checkpoint(a.join(b, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("further").alias("up")))
        if nxt.isEmpty():
            break
        jumps.append(nxt)
    parents = jumps[0].select(F.col("tree").alias("t"), F.col("up").alias("p"))
    leaves = kept.select("tree", "node").join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    if max_paths is not None:
        leaves = _best_leaves(kept, leaves, jumps, max_paths)
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up"))
        more = path.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + F.lit(1 << k)).alias("back"))
        path = checkpoint(path.unionByName(more))
    # a path counts if it begins at a root: not behind a cycle, and not behind a reply that is not kept
    held = kept.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score", F.col("up").isNull().alias("root"))
    scored = path.join(held, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).drop("t", "n")
    paths = scored.groupBy("tree", "leaf").agg(F.max("back").alias("depth"), F.avg("score").alias("mean_score"), F.max("root").alias("rooted")).where("rooted")
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean_score"), "leaf")))
    ranked = ranked.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "depth", "rank")
    chosen = path.join(ranked, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "node", "rank", (F.col("depth") - F.col("back")).alias("pos"))
    said = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return chosen.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", "pos", "role", "text")


def _best_leaves(kept: DataFrame, leaves: DataFrame, jumps: list[DataFrame], most: int) -> DataFrame:
    """tree, node of each tree's leaves with the best mean scores of their paths, up to `most` of those that begin at a root."""
    score = kept.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    sums = [checkpoint(jumps[0].join(score, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", "up", F.col("score").alias("sum")))]
    for _ in jumps[1:]:
        b = sums[-1].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("further"), F.col("sum").alias("more"))
        sums.append(checkpoint(sums[-1].join(b, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select("tree", "node", F.col("further").alias("up"), (F.col("sum") + F.col("more")).alias("sum"))))
    at = leaves.join(score, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", F.col("node").alias("leaf"), "node", F.col("score").alias("sum"), F.lit(1).cast("long").alias("count"))
    for k in reversed(range(len(sums))):
        jump = sums[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", F.col("sum").alias("more"))
        up = F.col("up").isNotNull()
        at = at.join(jump, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left")
        at = checkpoint(at.select("tree", "leaf", F.coalesce("up", "node").alias("node"), F.when(up, F.col("sum") + F.col("more")).otherwise(F.col("sum")).alias("sum"), (F.col("count") + F.when(up, 1 << k).otherwise(0)).alias("count")))
    roots = kept.where("up is null").select(F.col("tree").alias("t"), F.col("node").alias("n"))
    rooted = at.join(roots, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_semi")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("count")), "leaf")
    return rooted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("tree", F.col("leaf").alias("node"))


def format_paths(paths: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per path: tree, leaf, rank, formatted, loss_spans array<struct<start, length>>.

    start counts code points of `formatted` from 0; a span covers one whole escaped text of a role in
    loss_roles, in order."""
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(HEAD_END))
    body = escape(F.col("text"))
    turns = paths.select("tree", "leaf", "rank", "pos", "role", head.alias("head"), body.alias("body")).withColumn("turn", F.concat("head", "body", F.lit(TURN_END)))
    order = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("turn")).over(order)
    turns = turns.withColumn("start", F.lit(len(BEGIN)) + end - F.length("turn") + F.length("head")).withColumn("size", F.length("body")).withColumn("learn", F.col("role").isin(*loss_roles))
    one = F.struct("pos", "turn", F.when(F.col("learn"), F.struct(F.col("start").alias("start"), F.col("size").cast("long").alias("length"))).alias("span"))
    packed = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    text = F.concat(F.lit(BEGIN), F.concat_ws("", F.transform("turns", lambda x: x["turn"])))
    spans = F.transform(F.filter("turns", lambda x: x["span"].isNotNull()), lambda x: x["span"])
    return packed.select("tree", "leaf", "rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse `formatted`: adds turns array<struct<role, text>> and loss_text, both unescaped."""
    parts = F.split(F.expr(f"substring(formatted, {len(BEGIN) + 1})"), TURN_END, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    pattern = r"(?s)^<\|(.*?)\|>\n(.*)$"
    turns = F.transform(parts, lambda x: F.struct(unescape(F.regexp_extract(x, pattern, 1)).alias("role"), unescape(F.regexp_extract(x, pattern, 2)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.concat_ws("", loss)})


def linear_threads(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as reply trees in which each row answers the one before.

    Rows with equal turns are ordered by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})
