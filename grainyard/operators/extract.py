"""Messages from rows of JSON in many shapes, and from trees of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_english, normalize_role, normalize_turn
from ..sources.files import forget, saved
from .messages import merge_runs

# Keys that hold lists of messages, pairs of prompt and response, and what names roles and contents.
LIST_KEYS = ["messages", "conversation", "conversations", "turns", "dialog", "chat"]
PAIR_KEYS = [("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output"), ("input", "output")]
ROLE_KEYS = ["role", "from", "speaker", "author"]
CONTENT_KEYS = ["content", "value", "text", "message", "utterance"]


def _field(c: Column, key: str) -> Column:
    return F.get_json_object(c, f"$.{key}")


def _role(m: Column) -> Column:
    """Under the first role key that is there, even if it is null."""
    return F.coalesce(*[F.when(F.array_contains(F.json_object_keys(m), k), F.struct(_field(m, k).alias("r"))) for k in ROLE_KEYS])["r"]


def message_shapes(row: Column, include_input: bool = False) -> Column:
    """array<array<struct<role, content>>> of a JSON object: what each list key gives, then each pair with both sides, in the order in
    which they are tried; null for those that the row doesn't have. A list, or an element of it, may be JSON inside a string.
    include_input: the input is added below an instruction."""
    out = []
    for key in LIST_KEYS:
        inside = _field(row, key)
        listed = F.when(inside.rlike(r"^\s*\["), F.from_json(inside, "array<string>"))
        out.append(F.transform(listed, lambda m: F.struct(_role(m).alias("role"), F.coalesce(*[_field(m, k) for k in CONTENT_KEYS]).alias("content"))))
    for ask, answer in PAIR_KEYS:
        a, b = _field(row, ask), _field(row, answer)
        if include_input and ask == "instruction":
            more = _field(row, "input")
            a = F.when(normalize_turn(more) != "", F.concat(a, F.lit("\n\n"), more)).otherwise(a)
        both = F.array(F.struct(F.lit("user").alias("role"), a.alias("content")), F.struct(F.lit("assistant").alias("role"), b.alias("content")))
        out.append(F.when((normalize_turn(a) != "") & (normalize_turn(b) != ""), both))
    return F.array(*out)


def extract_messages(rows: DataFrame, id_col: str, json_col: str, include_input: bool = False) -> DataFrame:
    """(row_id, shape, pos, role, content), a row a message of each shape that the row has; a row of JSON without messages gives none."""
    shapes = rows.select(F.col(id_col).alias("row_id"), F.posexplode(message_shapes(F.col(json_col), include_input)).alias("shape", "list"))
    return shapes.select("row_id", "shape", F.posexplode("list").alias("pos", "m")).select("row_id", "shape", "pos", "m.role", "m.content")


def row_messages(rows: DataFrame, id_col: str, json_col: str, include_input: bool = False) -> DataFrame:
    """(row_id, i, role, content): of each row the merged messages of the first shape that gives a conversation."""
    found = extract_messages(rows, id_col, json_col, include_input)
    merged = merge_runs(found.select(F.struct("row_id", "shape").alias("row_id"), "pos", "role", "content"))
    told = merged.select("row_id.*", "i", "role", "content").withColumn("_first", F.min("shape").over(Window.partitionBy("row_id")))
    return told.where("shape = _first").select("row_id", "i", "role", "content")


TREE_COLUMNS = {"message_id", "parent_id", "role", "text"}


def is_tree(rows: DataFrame) -> bool:
    """Whether the columns are those of messages that point to their parents."""
    return TREE_COLUMNS <= set(rows.columns)


def tree_sources(rows: DataFrame, source: str, json_col: str) -> DataFrame:
    """(source, tree): whether all of a source's rows of JSON have the keys of messages that point to their parents."""
    keys = F.json_object_keys(json_col)
    return rows.groupBy(source).agg(F.every(F.coalesce(F.size(F.array_except(F.array(*map(F.lit, sorted(TREE_COLUMNS))), keys)) == 0, F.lit(False))).alias("tree"))


def tree_chains(messages: DataFrame, order: str, max_depth: int = 0) -> DataFrame:
    """(row_id, pos, role, content): for each assistant message the chain from its root down to it, row_id its id.

    messages: (message_id, parent_id, role, text) and the column `order`; of equal ids the last in order counts, rows without an id
    don't. A chain ends at a parent that isn't there, and before a message that it already holds. Jumps over 1, 2, 4, ... parents
    are joined to the chains found so far, so that the number of joins is the logarithm of the deepest chain; the rows held are the
    rows returned, in a chain of n answers about n * n. max_depth: only so many messages above each (0: all). Rounds are written to
    the shared folder, and those of the round before deleted.
    """
    known = _last_messages(messages, order)
    starts = known.where(normalize_role(F.col("role")) == "assistant").select(F.col("message_id").alias("leaf"))
    return _chains(known, starts, max_depth)


def _last_messages(messages: DataFrame, order: str) -> DataFrame:
    last = messages.where("message_id IS NOT NULL").groupBy("message_id").agg(F.max_by(F.struct("parent_id", "role", "text"), order).alias("m"))
    return saved(last.select("message_id", "m.*"), "tree")


def _chains(known: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(row_id, pos, role, content) for each of the messages `starts` (leaf), which are different ones of `known`."""
    jump = saved(known.select("message_id", "parent_id").join(known.select(F.col("message_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("message_id").alias("at"), F.col("parent_id").alias("to")), "jump")
    chains = saved(starts.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("up")), "chains")
    size, step = chains.count(), 1
    while True:
        further = chains.join(jump, F.col("node") == F.col("at")).select("leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        further = further.where(F.col("up") <= max_depth) if max_depth else further
        longer = saved(chains.union(further).groupBy("leaf", "node").agg(F.min("up").alias("up")), "chains")
        forget(chains)
        chains = longer
        grown = chains.count()
        if grown == size:
            break
        size, step = grown, step * 2
        ahead = jump.select(F.col("at").alias("mid"), F.col("to").alias("end"))
        further = saved(jump.join(ahead, F.col("to") == F.col("mid")).select("at", F.col("end").alias("to")), "jump")
        forget(jump)
        jump = further
    texts = known.select(F.col("message_id").alias("node"), "role", F.col("text").alias("content"))
    return chains.join(texts, "node").select(F.col("leaf").alias("row_id"), (-F.col("up")).alias("pos"), "role", "content")


def tree_paths(known: DataFrame) -> DataFrame:
    """A row a message of known (message_id, parent_id, role, text; ids are unique): node, parent, answer (an assistant's), n (messages
    from its root down to it), first (the role of the first of them that a conversation keeps), answered (whether it keeps an
    assistant's), above (characters that it keeps before this one), looped (no root: its parents lead into a circle; the rest is null).

    What lies between a message and one further up is put together from two halves, so that rows stay one a message and rounds are
    the logarithm of the deepest chain.
    """
    role, content = normalize_role(F.col("role")), normalize_turn(F.col("text"))
    own = F.when(role.isin("user", "assistant") & (content != ""), F.length(content)).otherwise(0).cast("bigint")
    there = known.select(F.col("message_id").alias("parent"))
    told = known.select(F.col("message_id").alias("node"), "parent_id", role.alias("r"), own.alias("own")).join(there, F.col("parent_id") == F.col("parent"), "left")
    kept = F.coalesce(F.col("own") > 0, F.lit(False))
    state = saved(told.select("node", "parent", (F.col("r") == "assistant").alias("answer"), "own", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("n"), F.when(kept, F.col("r")).alias("first"), (kept & (F.col("r") == "assistant")).alias("answered"), F.col("own").alias("chars")), "paths")
    rounds = max(state.count(), 1).bit_length()
    for _ in range(rounds):
        if state.where("up IS NOT NULL").isEmpty():
            break
        top = state.select(F.col("node").alias("t"), F.col("up").alias("t_up"), F.col("n").alias("t_n"), F.col("first").alias("t_first"), F.col("answered").alias("t_answered"), F.col("chars").alias("t_chars"))
        joined = state.join(top, F.col("up") == F.col("t"), "left")
        none = lambda c: F.coalesce(c, F.lit(0))
        further = joined.select(
            "node", "parent", "answer", "own", F.col("t_up").alias("up"), (F.col("n") + none("t_n")).alias("n"), F.coalesce("t_first", "first").alias("first"),
            (F.col("answered") | F.coalesce("t_answered", F.lit(False))).alias("answered"), (F.col("chars") + none("t_chars")).alias("chars"),
        )
        further = saved(further, "paths")
        forget(state)
        state = further
    looped = F.col("up").isNotNull()
    return state.select("node", "parent", "answer", *[F.when(~looped, F.col(c)).alias(c) for c in ("n", "first", "answered")], F.when(~looped, F.col("chars") - F.col("own")).alias("above"), looped.alias("looped"))


def _tops(paths: DataFrame, leaves: DataFrame, reach: int) -> DataFrame:
    """(leaf, top): for each leaf the last message down to it with at most `reach` characters above."""
    out = paths.where(F.col("above") > reach)
    jump = saved(out.select(F.col("node").alias("at"), F.col("parent").alias("to")), "tops")
    while True:
        ahead = jump.select(F.col("at").alias("mid"), F.col("to").alias("end"))
        if jump.join(ahead, F.col("to") == F.col("mid"), "left_semi").isEmpty():
            break
        further = saved(jump.join(ahead, F.col("to") == F.col("mid"), "left").select("at", F.coalesce("end", "to").alias("to")), "tops")
        forget(jump)
        jump = further
    return leaves.join(jump, F.col("leaf") == F.col("at"), "left").select("leaf", F.coalesce("to", "leaf").alias("top"))


def tree_import(messages: DataFrame, order: str, languages: list[str], source: str, build, max_depth: int = 0, reach: int = 0) -> tuple[DataFrame, DataFrame]:
    """Examples of the trees' English messages, and one row of counts: non_english_rows, bad_paths (chains that are no conversation)
    and paths_kept (examples).

    messages: as for tree_chains, and the columns of languages. A message in another language is taken out before links are followed,
    so that a chain ends below it. build: examples of merged messages (row_id, i, role, content). reach: build takes no message behind so
    many kept characters of its chain into an example (as with the longest prompt and the longest message that it takes, together).
    Then whole chains are only summed up (see tree_paths), and their messages put together as far as that reaches, so that rows grow
    with the messages and not with the depth of trees; 0: whole chains, as with max_depth.
    """
    english = is_english(*[F.col(c) for c in languages])
    told = messages.withColumn("_en", english)
    foreign = told.agg(F.count_if(~F.col("_en")).alias("non_english_rows"))
    known = _last_messages(told.where("_en").drop("_en", *languages), order)
    if reach and not max_depth:
        paths = saved(tree_paths(known), "paths")
        leaves = paths.where("answer AND NOT looped")
        good = F.coalesce((F.col("n") >= 2) & (F.col("first") == "user") & F.col("answered"), F.lit(False))
        bad = leaves.agg(F.count_if(~good).alias("_bad"))
        tops = saved(_tops(paths.where("NOT looped"), leaves.where(good).select(F.col("node").alias("leaf")), reach), "tops")
        upper = _chains(known, tops.select(F.col("top").alias("leaf")).distinct(), 0)
        chains = tops.join(upper, F.col("top") == F.col("row_id")).select(F.col("leaf").alias("row_id"), "pos", "role", "content")
        rest = _chains(known, paths.where("answer AND looped").select(F.col("node").alias("leaf")), 0)  # chains that begin where they would repeat
    else:
        rest = _chains(known, known.where(normalize_role(F.col("role")) == "assistant").select(F.col("message_id").alias("leaf")), max_depth)
        bad = None
    looped = saved(merge_runs(rest), "talks")
    talks = looped if bad is None else looped.union(merge_runs(chains))
    found = saved(build(talks), "examples")
    ends = rest.where("pos = 0").agg(F.count("*").alias("_paths")).crossJoin(looped.agg(F.count_distinct("row_id").alias("_good")))  # one row each
    counts = foreign.crossJoin(ends if bad is None else ends.crossJoin(bad)).crossJoin(found.agg(F.count("*").alias("paths_kept")))
    lost = F.col("_paths") - F.col("_good") + (F.lit(0) if bad is None else F.col("_bad"))
    return found, counts.select(F.lit(source).alias("source"), "non_english_rows", lost.alias("bad_paths"), "paths_kept")
