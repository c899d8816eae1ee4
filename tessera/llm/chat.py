"""Reply trees as conversations: every root-to-leaf path is a branch, the best are formatted.

Messages (tree_id, node_id, parent_id, role, text, score) form trees. Iterative self-joins
double each message's reach towards its root: round k joins what 2^k messages up sum to
with what the next 2^k do, one row a message, so a thread of n turns takes log2(n) rounds.
That gives the score and length of every root-to-leaf path at its leaf. Branches rank by
the sum of their messages' scores (null: 0), then length, then smaller leaf; the best
`branches` of each tree are laid out by joins with the same 2^k-th ancestors, each round
doubling the stretch of a path, and formatted. Only as many rounds are made as the longest
path needs, and cycles never multiply rows.

    <s> ( <|turn|> role <|text|> text </s> )*

(without the blanks). Inside roles and texts a backslash is doubled and a control string
gets a backslash after its first character; dropping every backslash but the character
behind it restores the text. Control strings are those above and the bracketed ones of
common chat templates. The loss mask is the spans (0-based start and length in code
points of the formatted text) of the assistant's texts.

Null roles and texts count as empty, null tree ids as one tree; a parent that isn't there, or
is null, makes a root; a null node id can't be replied to, so each such message is a branch
of its own below its parent, at leaf null; rows that repeat a (tree, node) are one message,
the smallest row; messages that only cycle, or hang on a cycle, reach no root and are in no
path; texts of any length are formatted whole; an empty table gives an empty result; only
the six columns are read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

BEGIN, TURN, TEXT, END = "<s>", "<|turn|>", "<|text|>", "</s>"
CONTROL = r"(<|\[)(/?s>|\|(?:turn|text)\|>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reaches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, key, total, n) of all messages that reach a root: the score and number of those from it up to the root;
    and for each k the 2^k-th ancestors (tree, key, to), if there. nodes: tree, key, up (the key of the named parent, or null), score."""
    now = nodes.select("tree", "key", F.col("up").alias("to"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("n"))
    hops, done = [], -1
    while True:
        rooted = now.where("to IS NULL").count()
        if rooted == done:  # no message is 2^k to 2^(k+1) deep, so none is deeper: the others hang on cycles
            break
        done = rooted
        hops.append(now.where("to IS NOT NULL").select("tree", "key", "to"))
        above = now.select("tree", F.col("key").alias("to"), F.struct("to", "total", "n").alias("above"))
        further = now.where("to IS NOT NULL").join(above, ["tree", "to"], "left")  # a parent that isn't there ends the path
        more = lambda c: (F.col(c) + F.coalesce(F.col(f"above.{c}"), F.lit(0))).alias(c)
        further = further.select("tree", "key", F.col("above.to").alias("to"), more("total"), more("n"))
        now = stored(now.where("to IS NULL").unionByName(further), f"reach-{len(hops)}")
    return now.where("to IS NULL").select("tree", "key", "total", "n"), hops


def laid_out(leaves: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """(tree, leaf, branch, key, up) of the paths from leaves (tree, leaf, branch, n) to their roots; up: steps from the leaf."""
    found = leaves.select("tree", "leaf", "branch", F.col("leaf").alias("key"), F.lit(0).cast("long").alias("up"))
    longest = leaves.agg(F.max("n")).first()[0] or 0
    for k, hop in enumerate(hops):
        if 1 << k >= longest:
            break
        further = found.join(hop, ["tree", "key"]).select("tree", "leaf", "branch", F.col("to").alias("key"), (F.col("up") + (1 << k)).alias("up"))
        found = stored(found.union(further), "paths")
    return found


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, leaf, rank, of, total, formatted, mask) of the best branches of each tree; of: its number of branches."""
    rows = messages.select(F.struct("tree_id").alias("tree"), F.col("node_id").alias("node"), F.struct(F.col("parent_id").alias("parent"), "role", "text", F.col("score").cast("double").alias("score")).alias("m"))
    named = rows.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min("m").alias("m")).withColumn("key", F.struct("node", F.lit(0).cast("long").alias("again")))
    nameless = rows.where("node IS NULL").withColumn("key", F.struct("node", F.monotonically_increasing_id().alias("again")))
    up = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("node"), F.lit(0).cast("long").alias("again")))
    nodes = stored(named.unionByName(nameless).select("tree", "key", "m.*").withColumn("up", up), "messages")
    reach, hops = reaches(nodes)
    replied = nodes.where("up IS NOT NULL").select("tree", F.col("up").alias("key")).distinct()
    scored = reach.join(replied, ["tree", "key"], "left_anti").withColumnRenamed("key", "leaf")
    best = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("n").desc(), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    counts = scored.groupBy("tree").agg(F.count("*").alias("of"))
    chosen = stored(chosen.join(counts, "tree").select("tree", "leaf", "n", F.struct("rank", "of", "total").alias("branch")), "chosen")

    turns = laid_out(chosen, hops).join(nodes.select("tree", "key", "role", "text"), ["tree", "key"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.select("tree", "leaf", "branch", "up", (role == "assistant").alias("own"), F.concat(F.lit(TURN), escaped(role), F.lit(TEXT)).alias("head"), escaped(text).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(BEGIN) + F.length("head")
    turns = turns.withColumn("span", F.when(F.col("own"), F.struct(start.cast("int").alias("start"), F.length("body").alias("length"))))
    turn = F.struct((-F.col("up")).alias("at"), "branch", "piece", "span")
    out = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return out.select(
        "tree.tree_id",
        F.col("leaf.node").alias("leaf"),
        F.col("turns")[0]["branch"]["rank"].alias("rank"),
        F.col("turns")[0]["branch"]["of"].alias("of"),
        F.col("turns")[0]["branch"]["total"].alias("total"),
        F.concat(F.lit(BEGIN), F.array_join("turns.piece", "")).alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("mask"),
    )


def turns_of(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)

    def back(part: Column) -> Column:
        role = F.substring_index(part, TEXT, 1)
        body = F.substr(part, F.length(role) + len(TEXT) + 1, F.length(part) - F.length(role) - len(TEXT) - len(END))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, back)


def masked(formatted: Column, mask: Column) -> Column:
    """The text under the mask, restored."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def threads(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of that tree_id.

    Each turn replies to the one before, and each but the first has a rival: a reply that
    gives the text before it in reverse. A turn scores 1 and its text's length modulo 7, a
    rival a sixteenth of its own modulo 11, so of all branches the one without a rival is best.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("k"), F.lag("text").over(order).alias("before"))
    size = lambda x: F.length(F.coalesce(x, F.lit("")))
    message = lambda node, role, text, score: F.struct(node.alias("node_id"), role.alias("role"), text.alias("text"), score.cast("double").alias("score"))
    own = message(2 * F.col("k"), F.col("role"), F.col("text"), size(F.col("text")) % 7 + 1)
    rival = message(2 * F.col("k") + 1, F.lit("assistant"), F.reverse(F.coalesce("before", F.lit(""))), size(F.col("before")) % 11 / 16)
    every = at.select("conv_id", "k", F.explode(F.when(F.col("k") > 1, F.array(own, rival)).otherwise(F.array(own))).alias("m"))
    return every.select(F.col("conv_id").alias("tree_id"), "m.node_id", F.when(F.col("k") > 1, 2 * F.col("k") - 2).alias("parent_id"), "m.role", "m.text", "m.score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = conversations(threads(rows.union(probe)))
    turns = turns_of(F.col("formatted"))
    out = out.withColumn("turns", turns).withColumn("loss", masked(F.col("formatted"), F.col("mask")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("of").alias("branches"),
        F.col("total").alias("best_score"),
    )


QUERIES = {"op3_reply_trees": op3}
OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, 20 + length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?s>|\|(?:turn|text)\|>|/?INST\]|</?SYS>>)', '\1#\2', 'g'))
              + length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?s>|\|(?:turn|text)\|>|/?INST\]|</?SYS>>)', '\1#\2', 'g')) AS n
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n))::BIGINT AS formatted_chars, count(*)::BIGINT AS branches, sum(1 + length(text) % 7)::DOUBLE AS best_score
FROM e GROUP BY conv_id
"""
ORACLE = {"op3_reply_trees": OP3_SQL}
