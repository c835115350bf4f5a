"""Chat formatting of reply trees.

Messages point to the message that they reply to. Iterative self-joins double the reach of each message's pointer until it
holds its root, its depth and the score of its branch; the best branches of each tree are chosen by score; going back through
the kept pointers, from the longest to the shortest, enumerates the messages of each chosen path. Each path becomes one
conversation. Both directions take a number of joins that is the logarithm of the deepest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning in this or other common templates, each with what stands for it inside a text.
CONTROL = [(START, "<\\|im_start|>"), (END, "<\\|im_end|>"), ("<|endoftext|>", "<\\|endoftext|>"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]")]


def escaped(c: Column) -> Column:
    """Backslashes doubled, and one put into each control string. Reversible."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, shown in CONTROL:
        c = F.replace(c, F.lit(plain), F.lit(shown))
    return c


def unescaped(c: Column) -> Column:
    """A pair of backslashes is one; a single one goes."""
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def escaped_role(c: Column) -> Column:
    """As escaped; a line feed becomes backslash n, since it ends the role."""
    return F.replace(escaped(c), F.lit("\n"), F.lit("\\n"))


def unescaped_role(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))), "\\")


def tree_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(leaf, node, up): the messages of the chosen root-to-leaf paths, `up` steps above the leaf.

    messages: (id, parent, score), ids distinct and not null. In each tree the `per_tree` leaves of highest total score from the
    root are chosen, ties by id; a null score counts 0. A parent that isn't a message makes a root. Messages on or below a cycle
    reach no root and belong to no path. Only messages that haven't reached their root take part in the next join.
    """
    base = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = base.select(F.col("id").alias("known"))
    first = base.join(known, base.parent == known.known, "left").select(F.col("id").alias("node"), F.col("id").alias("top"), F.col("known").alias("up"), F.col("score").alias("total"))
    state = written(first, "reach")
    done, steps = state.where("up IS NULL"), [state.where("up IS NOT NULL")]
    rounds = max(1, state.count()).bit_length() + 1  # a pointer that is left then is on a cycle
    while len(steps) <= rounds and steps[-1].limit(1).count():
        reached = done.union(steps[-1])
        other = reached.select(F.col("node").alias("at"), F.col("top").alias("top2"), F.col("up").alias("up2"), F.col("total").alias("total2"))
        further = steps[-1].join(other, F.col("up") == F.col("at")).select("node", F.col("top2").alias("top"), F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"))
        state = written(further, "reach")
        done = done.union(state.where("up IS NULL"))
        steps.append(state.where("up IS NOT NULL"))
    leaves = done.join(steps[0].select(F.col("up").alias("node")), "node", "left_anti")
    order = Window.partitionBy("top").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_tree)
    paths = written(chosen.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "paths")
    for k in reversed(range(len(steps) - 1)):
        jump = steps[k].select(F.col("node").alias("at"), F.col("up").alias("to"))
        more = paths.join(jump, F.col("node") == F.col("at")).select("leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = paths.union(written(more, "paths"))  # only the messages that this round finds
    return paths


def formatted(paths: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a path: key, leaf, n_turns, formatted (the text) and loss_spans (start and length, in code points, of the texts
    under the loss mask). messages: (id, key, role, text); nulls in role and text count as empty.

    A turn is START role LF text END LF, with control strings inside role and text escaped. Spans come from a running sum, so a
    path of very many turns is sorted and not held until its text is put together, which one row of output needs.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    body = escaped(text)
    said = messages.select(F.col("id").alias("node"), "key", head.alias("head"), body.alias("body"), (role == loss_role).alias("loss"))
    rows = paths.join(said, "node").withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    order = Window.partitionBy("leaf").orderBy(F.desc("up"))
    rows = rows.withColumn("start", F.sum("size").over(order) - F.col("size") + F.length("head"))
    turn = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END + "\n")).alias("text"), "loss", "start", F.length("body").cast("bigint").alias("length"))
    whole = rows.groupBy("leaf").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select("key", "leaf", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """From formatted and loss_spans alone, one row a turn: leaf, at, role, text, and loss_text (what the mask covers, unescaped;
    null outside it)."""
    cut = conversations.select("leaf", F.posexplode(F.split("formatted", r"<\|im_end\|>\n", -1)).alias("at", "piece")).where(F.col("piece") != "")
    order = Window.partitionBy("leaf").orderBy("at")
    cut = cut.withColumn("from", F.sum(F.length("piece") + len(END) + 1).over(order) - F.length("piece") - len(END) - 1)
    cut = cut.withColumn("role", F.substring_index("piece", "\n", 1))
    cut = cut.withColumn("start", F.col("from") + F.length("role") + 1)
    spans = conversations.select("leaf", F.explode("loss_spans").alias("s")).select("leaf", "s.start", "s.length")
    both = cut.join(spans, ["leaf", "start"], "left")
    text = F.expr("substring(piece, length(role) + 2)")
    masked = F.expr("substring(piece, length(role) + 2, int(length))")
    return both.select("leaf", "at", unescaped_role(F.expr(f"substring(role, {len(START) + 1})")).alias("role"), unescaped(text).alias("text"), F.when(F.col("length").isNotNull(), unescaped(masked)).alias("loss_text"))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each replying to the one before it. Turns in ascending order, null first, ties by
    role and text; a null conv_id is a conversation of its own."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).alias("n"))
    at = lambda n: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), n.cast("string"))
    parent = F.when(F.col("n") > 1, at(F.col("n") - 1))
    return numbered.select(at(F.col("n")).alias("id"), parent.alias("parent"), F.lit(1.0).alias("score"), F.col("conv_id").alias("key"), "role", "text")


def formatted_digests(turns: DataFrame) -> DataFrame:
    """Format the conversations, write them to the shared folder, read them back and take digests of what was read.

    Returns conv_id, n_turns, turns_sha256 (role LF text LF of each turn), loss_chars, loss_sha256 (all text under the mask),
    formatted_chars. Empty tables give empty ones; repeated turns are turns.
    """
    messages = written(conversation_messages(turns), "messages")
    stored = written(formatted(tree_paths(messages), messages), "chat")
    each = read_back(stored).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "loss_text"))).alias("t"))
    each = each.select("leaf", F.size("t").cast("bigint").alias("n_turns"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"), F.array_join(F.transform("t", lambda x: F.coalesce(x["loss_text"], F.lit(""))), "").alias("loss"))
    sizes = stored.select("leaf", F.col("key").alias("conv_id"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return each.join(sizes, "leaf").select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def _sql_escaped(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for plain, shown in CONTROL:
        c = f"replace({c}, '{plain}', '{shown}')"
    return c


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 2} + length({_sql_escaped('text')}) + length(replace({_sql_escaped('role')}, chr(10), '\\n')))::bigint AS formatted_chars
FROM n GROUP BY conv_id
"""
