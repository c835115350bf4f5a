"""More queries: files read back, exact splits, arrays of training windows, mixtures of batches, unions, and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters, text
from ..operators import extract, gate, messages, ordering, packing, runs, splits, templates
from ..sources import files
from ..streaming import ingest
from .core import (
    DEFAULT_SQL, END, SQL, TEMPLATE_SQL, WIDE, WIDE_SQL, candidates, completions, docstring_paragraphs, lit, markdown_paragraphs, query, s_direct, s_document_reason, s_examples, s_norm, s_role, s_split, s_squash, s_strip, s_turn, table, tree_messages,
    turns_of, wide_examples,
)

# --- files ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT sha1({s_norm('text')}) AS text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def text_files(spark, sf_dir):
    path = files.work_path(spark, "texts")
    table(spark, sf_dir, "documents").select("doc_id", "text", "source").write.parquet(path)
    return files.read_texts(spark, path).groupBy(text.sha1_hex(F.col("text")).alias("text")).agg(F.count("*").alias("n"))


def paragraph_files(spark, sf_dir) -> str:
    """Documents with blank lines behind sentences, written in the order of their ids."""
    path = files.work_path(spark, "paragraphs")
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n \n")).alias("value"))
    docs.write.option("lineSep", "\n\n").text(path)
    return path


PARTS = f"""WITH p AS (SELECT doc_id, generate_subscripts(c, 1) AS k, unnest(c) AS p FROM (SELECT doc_id, regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\\n\\s*\\n') AS c FROM documents)),
q AS (SELECT doc_id, k, {s_strip('p')} AS p FROM p WHERE {s_strip('p')} <> '')
"""


@query(PARTS + "SELECT sha1(p) AS text, count(*) AS n FROM q GROUP BY 1")
def paragraphs_of_files(spark, sf_dir):
    found = files.read_paragraphs(spark, paragraph_files(spark, sf_dir))
    return found.groupBy(text.sha1_hex(F.col("text")).alias("text")).agg(F.count("*").alias("n"))


@query(PARTS + "SELECT sha1(p) AS text, count(*) AS n FROM (SELECT p FROM q ORDER BY doc_id, k LIMIT 500) GROUP BY 1")
def first_paragraphs(spark, sf_dir):
    found = files.read_paragraphs(spark, paragraph_files(spark, sf_dir), 500)
    return found.groupBy(text.sha1_hex(F.col("text")).alias("text")).agg(F.count("*").alias("n"))


@query("SELECT sha1(text) AS text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def jsonl_texts(spark, sf_dir):
    path = files.work_path(spark, "jsonl")
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text").write.json(path)
    return files.read_jsonl_texts(spark, path).groupBy(text.sha1_hex(F.col("text")).alias("text")).agg(F.count("*").alias("n"))


def plain_sft_files(spark, sf_dir) -> str:
    """Examples without ids, targets and chats, in the order of the ids that they had."""
    path = files.work_path(spark, "sft")
    wide_examples(spark, sf_dir).orderBy("id").select("prompt_text", "assistant_text").write.json(path)
    return path


SFT_SQL = WIDE_SQL + " SELECT 'example_' || row_number() OVER (ORDER BY id) AS id, sha1(target_text) AS target, sha1(chat_text) AS chat FROM examples"


@query(SFT_SQL)
def sft_of_files(spark, sf_dir):
    found = files.read_sft(spark, plain_sft_files(spark, sf_dir))
    return found.select("id", text.sha1_hex(F.col("target_text")).alias("target"), text.sha1_hex(F.col("chat_text")).alias("chat"))


@query(SFT_SQL + " ORDER BY examples.id LIMIT 40")
def first_sft(spark, sf_dir):
    found = files.read_sft(spark, plain_sft_files(spark, sf_dir), 40)
    return found.select("id", text.sha1_hex(F.col("target_text")).alias("target"), text.sha1_hex(F.col("chat_text")).alias("chat"))


@query(WIDE_SQL + f" SELECT {s_split('dialogue_group', 20, 40)} AS split, count(*) AS examples, count(*) AS chats, sum(length({s_strip('chat_text')}))::bigint AS characters FROM examples GROUP BY 1")
def sft_sink(spark, sf_dir):
    path = files.work_path(spark, "sft")
    files.write_sft(wide_examples(spark, sf_dir).withColumn("split", splits.group_split(F.col("dialogue_group"))), path)
    rows = spark.read.json(f"{path}/examples").groupBy("split").agg(F.count("*").alias("examples"))
    chats = spark.read.option("lineSep", "\n\n").text(f"{path}/chats").where("value <> ''").groupBy("split").agg(F.count("*").alias("chats"), F.sum(F.length("value")).alias("characters"))
    return rows.join(chats, "split").select("split", "examples", "chats", "characters")


@query("SELECT doc_id, substr('real_' || lower(regexp_replace(regexp_replace(source || '--V1.jsonl', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 80) AS label FROM documents")
def source_labels(spark, sf_dir):
    path = F.concat(F.lit("/data/in/"), "source", F.lit("--V1.jsonl.gz"))
    return table(spark, sf_dir, "documents").select("doc_id", files.source_label(path, "real").alias("label"))


VOCAB = "SELECT token, row_number() OVER (ORDER BY token) AS token_id FROM (SELECT DISTINCT token FROM (SELECT unnest(string_split(text, '')) AS token FROM documents UNION ALL SELECT chr(10)) WHERE token <> '')"


@query(VOCAB)
def vocab_file(spark, sf_dir):
    path = files.work_path(spark, "vocab")
    packing.write_vocab(packing.char_vocab(table(spark, sf_dir, "documents"), "text"), path)
    return packing.read_vocab(spark, path)


# --- rows, trees and unions ----------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 > 0 THEN (conv_id % 3)::varchar WHEN turn % 2 = 0 AND conv_id % 5 > 0 THEN 'h' || conv_id ELSE turn::varchar END AS row_id FROM conversations")
def row_ids(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    name = F.when((F.col("turn") % 2 == 0) & (F.col("conv_id") % 5 > 0), F.concat(F.lit("h"), F.col("conv_id").cast("string"))).otherwise("")
    return turns.select("conv_id", "turn", messages.row_id(F.col("conv_id") % 3, name, index=F.col("turn")).alias("row_id"))


@query("SELECT conv_id, conv_id % 3 > 0 AS tree FROM conversations GROUP BY conv_id")
def tree_files(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("message_id"), F.lit(None).cast("string").alias("parent_id"), F.when((F.col("conv_id") % 3 > 0) | (F.col("turn") != 1), F.col("role")).alias("role"), "text")
    told = F.struct("message_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "role", "text")
    return extract.tree_sources(turns.select("conv_id", F.to_json(told).alias("row")), "conv_id", "row")


LANGUAGE = "CASE WHEN (conv_id + turn) % 11 = 0 THEN 'fr' WHEN turn % 3 = 0 THEN 'EN_us' END"
ENGLISH_TREE = f"""(WITH RECURSIVE m AS (SELECT conv_id || '_' || turn AS message_id, CASE WHEN turn = 0 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN 'nowhere' ELSE conv_id || '_' || (turn - 1) END AS parent_id, role, text
    FROM conversations WHERE coalesce({LANGUAGE}, 'en') <> 'fr'), c AS (
  SELECT message_id AS conv_id, 0 AS turn, role, text, parent_id FROM m WHERE role = 'assistant'
  UNION ALL SELECT c.conv_id, c.turn - 1, m.role, m.text, m.parent_id FROM c JOIN m ON m.message_id = c.parent_id)
  SELECT conv_id, turn, role, text FROM c)"""


def english_tree(spark, sf_dir) -> DataFrame:
    lang = F.when((F.split("message_id", "_")[0].cast("bigint") + F.col("n")) % 11 == 0, "fr").when(F.col("n") % 3 == 0, "EN_us")
    return tree_messages(spark, sf_dir).withColumn("lang", lang)


def tree_imported(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    def build(talks: DataFrame) -> DataFrame:
        return messages.build_examples(talks, "conversations", "conversations.parquet", 1, WIDE, WIDE, 20_000)

    reach = 20_000 + WIDE.max_chars
    return extract.tree_import(english_tree(spark, sf_dir), "n", ["lang"], "conversations", build, reach=reach)


@query(s_examples(1, WIDE, WIDE, 20_000, ENGLISH_TREE) + " SELECT id, dialogue_group, category, prompt_words FROM examples")
def tree_import_examples(spark, sf_dir):
    return tree_imported(spark, sf_dir)[0].select("id", "dialogue_group", "category", "prompt_words")


SHORT = filters.TextLimits(1, 1000, 400, 50)


@query(s_examples(0, SHORT, SHORT, 600, ENGLISH_TREE) + " SELECT id, dialogue_group, category, prompt_words FROM examples")
def tree_import_short(spark, sf_dir):
    """Limits beyond which most of a long chain isn't put together."""
    def build(talks: DataFrame) -> DataFrame:
        return messages.build_examples(talks, "conversations", "conversations.parquet", 0, SHORT, SHORT, 600)

    return extract.tree_import(english_tree(spark, sf_dir), "n", ["lang"], "conversations", build, reach=600 + SHORT.max_chars)[0].select("id", "dialogue_group", "category", "prompt_words")


@query(s_examples(1, WIDE, WIDE, 20_000, ENGLISH_TREE) + f""" SELECT 'conversations' AS source, (SELECT count(*) FROM conversations WHERE {LANGUAGE} = 'fr') AS non_english_rows,
  (SELECT count(*) FROM conversations WHERE role = 'assistant' AND coalesce({LANGUAGE}, 'en') <> 'fr') - (SELECT count(DISTINCT row_id) FROM merged) AS bad_paths, (SELECT count(*) FROM examples) AS paths_kept""")
def tree_import_counts(spark, sf_dir):
    return tree_imported(spark, sf_dir)[1]


@query("SELECT * FROM (" + WIDE_SQL + " SELECT id, source_group, category FROM examples) UNION ALL SELECT id, 'anchor', category FROM (" + SQL["template_examples"] + ")")
def all_examples(spark, sf_dir):
    anchors = templates.template_examples(candidates(spark, sf_dir), "anchor", "events.parquet")
    return wide_examples(spark, sf_dir).unionByName(anchors).select("id", "source_group", "category")


ENTRIES = f"SELECT doc_id || '.md' AS source_file, paragraph FROM ({SQL['markdown_paragraphs']}) UNION ALL SELECT doc_id || '.py', sha1(paragraph) FROM ({SQL['docstring_paragraphs']})"


def entries(spark, sf_dir) -> DataFrame:
    """Paragraphs of both kinds with the files that they are of."""
    name = lambda end: F.concat(F.col("doc_id").cast("string"), F.lit(end)).alias("source_file")
    code = docstring_paragraphs(spark, sf_dir).select(name(".py"), text.sha1_hex(F.col("paragraph")).alias("paragraph"))
    return markdown_paragraphs(spark, sf_dir).select(name(".md"), "paragraph").unionByName(code)


@query(ENTRIES)
def corpus_entries(spark, sf_dir):
    return entries(spark, sf_dir)


@query(f"SELECT DISTINCT source_file FROM ({ENTRIES})")
def source_files(spark, sf_dir):
    return entries(spark, sf_dir).select("source_file").distinct()


# --- splits --------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.8::double)) THEN 'training' WHEN r <= greatest(1, floor(n * 0.8::double)) + greatest(1, floor(n * 0.1::double)) THEN 'validation' ELSE 'testing' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)""")
def order_split(spark, sf_dir):
    return ordering.order_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'testing' ELSE 'training' END AS split FROM documents)
SELECT doc_id, CASE WHEN doc_id = (SELECT max(doc_id) FROM s WHERE split = 'training') THEN 'validation' ELSE split END AS split FROM s""")
def repaired_split(spark, sf_dir):
    given = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 9, "testing").otherwise("training").alias("split"))
    return splits.repair_empty(given, ["doc_id"])


# --- windows, batches and losses -----------------------------------------------------------------------------------------


def s_windows(stream: str) -> str:
    return f"""WITH s AS (SELECT {stream} AS s FROM documents),
c AS (SELECT unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) - 1 AS i FROM s),
d AS (SELECT c, i, i // 128 AS w FROM c UNION ALL SELECT c, i, i // 128 - 1 FROM c WHERE i % 128 = 0 AND i > 0),
w AS (SELECT w AS window_id, string_agg(c, '' ORDER BY i) AS x, count(*) AS n FROM d GROUP BY w)
SELECT window_id, sha1(x) AS text FROM w WHERE n = 129"""


@query(s_windows("string_agg(text || chr(30), '' ORDER BY doc_id)"))
def lm_windows_trailing(spark, sf_dir):
    found = packing.lm_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 128, "\x1e", trailing=True)
    return found.select("window_id", text.sha1_hex(F.col("window")).alias("text"))


@query(s_windows("substr(string_agg(text, chr(30) ORDER BY doc_id), 1, 100000)"))
def lm_windows_target(spark, sf_dir):
    found = packing.lm_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 128, "\x1e", most=100_000)
    return found.select("window_id", text.sha1_hex(F.col("window")).alias("text"))


# --- orders in which numbers repeat or are missing ------------------------------------------------------------------------


NR = "(SELECT doc_id, text, source, CASE WHEN doc_id % 11 > 0 THEN doc_id * 7919 % 13 END AS nr FROM documents)"


def repeated_numbers(spark, sf_dir) -> DataFrame:
    nr = F.when(F.col("doc_id") % 11 > 0, F.col("doc_id") * 7919 % 13)
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", nr.alias("nr"))


def s_stream(stream: str) -> str:
    return s_windows(stream.replace("ORDER BY doc_id", "ORDER BY nr NULLS FIRST, doc_id")).replace("FROM documents", f"FROM {NR}")


@query(f"SELECT doc_id, running FROM (SELECT doc_id, (sum(length(text) + 2) OVER (ORDER BY nr NULLS FIRST, doc_id))::bigint AS running FROM {NR}) WHERE running - 2 <= 300000")
def char_budget_ties(spark, sf_dir):
    return ordering.char_budget(repeated_numbers(spark, sf_dir), "nr", F.length("text"), 300_000, ["doc_id"]).select("doc_id", "running")


@query(f"""SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.8::double)) THEN 'training' WHEN r <= greatest(1, floor(n * 0.8::double)) + greatest(1, floor(n * 0.1::double)) THEN 'validation' ELSE 'testing' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY nr NULLS FIRST, doc_id) AS r, count(*) OVER () AS n FROM {NR})""")
def order_split_ties(spark, sf_dir):
    return ordering.order_split(repeated_numbers(spark, sf_dir), "nr", ["doc_id"]).select("doc_id", "split")


@query(f"""SELECT split, count(*) AS n FROM (SELECT CASE WHEN r <= greatest(1, floor(n * 0.8::double)) THEN 'training' WHEN r <= greatest(1, floor(n * 0.8::double)) + greatest(1, floor(n * 0.1::double)) THEN 'validation' ELSE 'testing' END AS split
FROM (SELECT row_number() OVER () AS r, count(*) OVER () AS n FROM {NR})) GROUP BY split""")
def rank_split_ties(spark, sf_dir):
    docs = repeated_numbers(spark, sf_dir).withColumn("key", text.sha1_hex(F.col("source")))  # few keys, and nothing to tell their rows apart
    return ordering.rank_split(docs, "key").groupBy("split").agg(F.count("*").alias("n"))


@query(s_stream("string_agg(text, chr(30) ORDER BY doc_id)"))
def lm_windows_ties(spark, sf_dir):
    found = packing.lm_windows(repeated_numbers(spark, sf_dir), "nr", "text", 128, "\x1e", ties=["doc_id"])
    return found.select("window_id", text.sha1_hex(F.col("window")).alias("text"))


@query(s_stream("string_agg(text || chr(30), '' ORDER BY doc_id)"))
def lm_windows_trailing_ties(spark, sf_dir):
    found = packing.lm_windows(repeated_numbers(spark, sf_dir), "nr", "text", 128, "\x1e", trailing=True, ties=["doc_id"])
    return found.select("window_id", text.sha1_hex(F.col("window")).alias("text"))


@query(s_stream("substr(string_agg(text, chr(30) ORDER BY doc_id), 1, 100000)"))
def lm_windows_target_ties(spark, sf_dir):
    found = packing.lm_windows(repeated_numbers(spark, sf_dir), "nr", "text", 128, "\x1e", most=100_000, ties=["doc_id"])
    return found.select("window_id", text.sha1_hex(F.col("window")).alias("text"))


@query(f"SELECT doc_id, ((row_number() OVER (ORDER BY nr NULLS FIRST, doc_id) - 1) // 8)::bigint AS batch_id FROM {NR} QUALIFY row_number() OVER (ORDER BY nr NULLS FIRST, doc_id) <= 160")
def first_batches_ties(spark, sf_dir):
    return packing.batches(repeated_numbers(spark, sf_dir), "nr", 8, ["doc_id"], first=20).select("doc_id", "batch_id")


@query(f"""WITH RECURSIVE f AS (SELECT source, row_number() OVER (ORDER BY source) AS k FROM (SELECT DISTINCT source FROM documents)),
r AS (SELECT doc_id, k, (sum(length(text) + 2) OVER (PARTITION BY k ORDER BY nr NULLS FIRST, doc_id))::bigint AS p FROM {NR} JOIN f USING (source)),
t AS (SELECT 0::bigint AS k, 0::bigint AS total UNION ALL SELECT t.k + 1, t.total + coalesce((SELECT max(p) FROM r WHERE r.k = t.k + 1 AND r.p - 2 <= b - t.total), 0)::bigint
  FROM t, (SELECT sum(length(text)) // 3 AS b FROM documents) WHERE t.k < (SELECT max(k) FROM f))
SELECT doc_id FROM r JOIN t ON t.k = r.k - 1, (SELECT sum(length(text)) // 3 AS b FROM documents) WHERE p - 2 <= b - total""")
def file_budget(spark, sf_dir):
    docs = repeated_numbers(spark, sf_dir)
    third = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 3
    return ordering.file_budget(docs, "source", "nr", F.length("text"), third, ["doc_id"]).select("doc_id")


@query(SQL["lm_windows_trailing"])
def stream_lm_windows(spark, sf_dir):
    """The documents arrive in three parts, each of which is a batch."""
    path = files.work_path(spark, "packed")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    for k in range(3):
        docs.where(F.least(F.floor(F.col("doc_id") * 3 / (last + 1)), F.lit(2)) == k).write.mode("append").parquet(f"{path}/in")
        ingest.packed_windows(spark.readStream.schema(docs.schema).parquet(f"{path}/in"), "doc_id", "text", 128, "\x1e", path)
    return ingest.read_packed(spark, path).select("window_id", text.sha1_hex(F.col("window")).alias("text"))


CONTEXT = 512


@query(WIDE_SQL + f""", v AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM conversations UNION SELECT chr(10)) WHERE token <> ''),
m AS (SELECT map(list(token), list(id)) AS m FROM v),
x AS (SELECT id, list_transform(string_split(prompt_text, ''), lambda c: coalesce(m[c], 1)) AS p, list_transform(string_split(target_text, ''), lambda c: coalesce(m[c], 1)) AS t FROM examples, m),
y AS (SELECT *, CASE WHEN len(p) < 1 OR len(t) < 1 THEN 'empty' WHEN len(t) > {CONTEXT} THEN 'too_long' WHEN len(p) + len(t) > {CONTEXT + 1} THEN 'truncated' ELSE 'kept' END AS status, least(len(p), {CONTEXT + 1} - len(t)) AS used FROM x),
z AS (SELECT id, status, used, len(t) AS n, CASE WHEN status IN ('kept', 'truncated') THEN list_concat(p[len(p) - used + 1:], t) END AS whole FROM y)
SELECT id, status, CASE WHEN whole IS NOT NULL THEN used END AS prompt_kept, CASE WHEN whole IS NOT NULL THEN n END AS loss_targets,
  sha1(array_to_string(list_resize(whole[:len(whole) - 1], {CONTEXT}, 0), ' ')) AS input_ids, sha1(array_to_string(list_resize(whole[2:], {CONTEXT}, 0), ' ')) AS target_ids,
  sha1(array_to_string(CASE WHEN whole IS NOT NULL THEN list_transform(range(1, {CONTEXT + 1}), lambda i: CASE WHEN i >= used AND i < used + n THEN 1 ELSE 0 END) END, ' ')) AS loss_mask FROM z""")
def sft_tensors(spark, sf_dir):
    found = wide_examples(spark, sf_dir).select("id", "prompt_text", "target_text")
    vocab = files.saved(packing.char_vocab(table(spark, sf_dir, "conversations"), "text"), "vocab")
    coded = packing.encode(found, "prompt_text", vocab).withColumnRenamed("ids", "p").drop("prompt_text")
    coded = packing.encode(coded, "target_text", vocab).withColumnRenamed("ids", "t")
    digest = lambda c: text.sha1_hex(F.array_join(F.transform(c, lambda x: x.cast("string")), " ")).alias(c)
    told = packing.sft_tensors(coded, "p", "t", CONTEXT, 0, ["id"])
    return told.select("id", "status", "prompt_kept", "loss_targets", *map(digest, ("input_ids", "target_ids", "loss_mask")))


BARE = """, bare AS (SELECT id, CASE WHEN length(target_text) % 3 = 0 THEN '' WHEN length(target_text) % 7 > 0 THEN prompt_text END AS prompt_text, CASE WHEN length(prompt_text) % 8 > 0 THEN target_text END AS target_text FROM examples)"""


@query(WIDE_SQL + BARE + """ SELECT id, status, CASE WHEN ok THEN used END AS prompt_kept, CASE WHEN ok THEN length(target_text) END AS loss_targets,
  CASE WHEN ok THEN sha1(substr(prompt_text, length(prompt_text) - used + 1) || target_text) END AS window_sha1 FROM (
SELECT *, status IN ('kept', 'truncated') AS ok, least(length(prompt_text), 513 - length(target_text)) AS used FROM (
SELECT *, CASE WHEN coalesce(length(prompt_text), 0) = 0 OR coalesce(length(target_text), 0) = 0 THEN 'empty' WHEN length(target_text) >= 513 THEN 'too_long' WHEN length(prompt_text) > 513 - length(target_text) THEN 'truncated' ELSE 'kept' END AS status FROM bare))""")
def sft_windows_bare(spark, sf_dir):
    """Examples of which some have no prompt or no target."""
    made, n, m = wide_examples(spark, sf_dir), F.length("target_text"), F.length("prompt_text")
    bare = made.select("id", F.when(n % 3 == 0, "").when(n % 7 > 0, F.col("prompt_text")).alias("prompt_text"), F.when(m % 8 > 0, F.col("target_text")).alias("target_text"))
    return packing.sft_windows(bare, CONTEXT).withColumn("window_sha1", text.sha1_hex(F.col("window"))).drop("window")


@query("SELECT id, status, prompt_kept, loss_targets, input_ids, target_ids, loss_mask FROM (" + SQL["sft_tensors"] + ") WHERE status IN ('kept', 'truncated')")
def stream_sft_tensors(spark, sf_dir):
    path = files.work_path(spark, "stream")
    wide_examples(spark, sf_dir).write.json(f"{path}/in")
    vocab = files.saved(packing.char_vocab(table(spark, sf_dir, "conversations"), "text"), "vocab")
    ingest.append_all(ingest.supervised_tensors(spark.readStream.schema(files.SFT_SCHEMA).json(f"{path}/in"), vocab, CONTEXT, 0), path)
    digest = lambda c: text.sha1_hex(F.array_join(F.transform(c, lambda x: x.cast("string")), " ")).alias(c)
    return spark.read.parquet(f"{path}/rows").select("id", "status", "prompt_kept", "loss_targets", *map(digest, ("input_ids", "target_ids", "loss_mask")))


@query("SELECT * FROM (" + WIDE_SQL + f""",
f AS (SELECT (row_number() OVER (ORDER BY sha1(id)) - 1) // 8 AS index, length(target_text) AS n FROM examples WHERE length(target_text) <= {CONTEXT}),
g AS (SELECT (unnest(range((greatest(sum(length(text)) + count(*) - 2, 0) // 128)::bigint)) // 8) AS index FROM documents),
b AS (SELECT 'sft' AS source, index, count(*) AS windows, sum(n)::bigint AS loss_targets FROM f GROUP BY index
  UNION ALL SELECT 'pretrain', index, count(*), CASE WHEN index % 5 = 0 THEN 0 ELSE count(*) * 128 END FROM g GROUP BY index),
c AS (SELECT count(*) FILTER (WHERE source = 'sft') AS s, count(*) FILTER (WHERE source = 'pretrain') AS p FROM b),
e AS (SELECT event_id AS i, CASE WHEN event_id % 5 < 3 THEN 'sft' ELSE 'pretrain' END AS source,
  CASE WHEN event_id % 5 < 3 THEN ((event_id // 5) * 3 + event_id % 5) % s ELSE ((event_id // 5) * 2 + event_id % 5 - 3) % p END AS index FROM events, c)
SELECT i, source, index, windows, loss_targets, CASE WHEN loss_targets > 0 THEN (sum((loss_targets > 0)::int) OVER (ORDER BY i))::bigint END AS update FROM e JOIN b USING (source, index))""")
def mixture_batches(spark, sf_dir):
    made = packing.sft_windows(wide_examples(spark, sf_dir), CONTEXT).where(F.col("status").isin("kept", "truncated")).withColumn("h", text.sha1_hex(F.col("id")))
    sft = packing.batches(files.saved(made.select("h", "loss_targets"), "sft"), "h", 8).groupBy(F.col("batch_id").alias("index")).agg(F.count("*").alias("windows"), F.sum("loss_targets").alias("loss_targets")).select(F.lit("sft").alias("source"), "*")
    lm = packing.batches(packing.lm_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 128, "\x1e"), "window_id", 8).groupBy(F.col("batch_id").alias("index")).agg(F.count("*").alias("windows"))
    lm = lm.select(F.lit("pretrain").alias("source"), "index", "windows", F.when(F.col("index") % 5 == 0, 0).otherwise(F.col("windows") * 128).alias("loss_targets"))  # every fifth is without targets
    batches = files.saved(sft.unionByName(lm), "batches")
    found = packing.mixture_batches([("sft", 3), ("pretrain", 2)], batches, table(spark, sf_dir, "events").select(F.col("event_id").alias("i")))
    return found.select("i", "source", "index", "windows", "loss_targets", "update")


@query("SELECT l_linestatus, round(avg(l_extendedprice / 10000), 6) AS mean_loss, round(exp(avg(l_extendedprice / 10000)), 4) AS perplexity, count(*) AS targets FROM lineitem GROUP BY l_linestatus")
def mean_loss(spark, sf_dir):
    found = runs.masked_loss(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_extendedprice") / 10000, strict=True)
    return found.withColumns({"mean_loss": F.round("mean_loss", 6), "perplexity": F.round("perplexity", 4)})


@query(f"""WITH c(case_id, i, prompt) AS (VALUES {', '.join(f"({lit(c[0])}, {i}, {lit(gate.PROMPTS[c[0]])})" for i, c in enumerate(gate.CASES))}),
t AS (SELECT DISTINCT conv_id, turn // 44 AS run, (turn % 44) // 2 AS i FROM conversations WHERE role = 'assistant')
SELECT r.conv_id, r.run, c.case_id, sha1(c.prompt) AS prompt FROM (SELECT DISTINCT conv_id, run FROM t) r CROSS JOIN c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = r.conv_id AND t.run = r.run AND t.i = c.i)""")
def gate_open_prompts(spark, sf_dir):
    found = gate.open_prompts(completions(spark, sf_dir), gate.cases(spark), ["conv_id", "run"])
    return found.select("conv_id", "run", "case_id", text.sha1_hex(F.col("prompt")).alias("prompt"))


# --- documents of JSON, and streams without copies ------------------------------------------------------------------------


@query("""SELECT conv_id AS row_id, turn AS pos, role, sha1('}{"],[' || chr(92) || '"' || coalesce(text, '')) AS content FROM conversations""")
def rows_of_lists(spark, sf_dir):
    path, file = files.work_path(spark, "lists") + ".json", F.pmod("conv_id", F.lit(8)).alias("file")
    said = F.concat(F.lit('}{"],[\\"'), F.coalesce("text", F.lit("")))
    row = F.to_json(F.struct("conv_id", F.struct("turn", F.array(F.struct("role", said.alias("text"))).alias("said")).alias("at")))
    turns = table(spark, sf_dir, "conversations").select(file, F.lit(1).alias("k"), F.concat(F.lit(","), row).alias("value"))
    edges = turns.select("file").distinct().select("file", F.explode(F.expr("map(0, '[[7, {\"a\": {}}]', 2, ',null ]')")).alias("k", "value"))
    turns.union(edges).repartition("file").sortWithinPartitions("file", "k").drop("k").write.partitionBy("file").text(path)
    r = F.from_json("row", "conv_id bigint, at struct<turn int, said array<struct<role string, text string>>>")
    found = files.read_rows(spark, path).select(r.alias("r")).select("r.conv_id", "r.at.turn", F.explode("r.at.said").alias("s"))
    return found.select(F.col("conv_id").alias("row_id"), F.col("turn").alias("pos"), "s.role", text.sha1_hex(F.col("s.text")).alias("content"))


@query(f"SELECT sha1(lower({s_squash('text')})) AS key, count(*) AS n FROM (SELECT DISTINCT ON (lower({s_squash('text')})) text FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def stream_first(spark, sf_dir):
    path, docs = files.work_path(spark, "stream"), table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    docs.repartition(5, "doc_id").write.option("maxRecordsPerFile", 0).parquet(f"{path}/in")
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.append_first(arriving, f"{path}/out", buckets=8)
    return ingest.read_first(spark, f"{path}/out", docs.schema).groupBy(text.sha1_hex(F.lower(text.squash(F.col("text")))).alias("key")).agg(F.count("*").alias("n"))


# --- run records of any shape ----------------------------------------------------------------------------------------------


def shaped_records(spark, sf_dir) -> DataFrame:
    """Records of users as runs in two shapes: epochs with their mean values, or a curriculum with a history of validations and losses by name."""
    events = table(spark, sf_dir, "events").withColumn("epoch", F.floor(F.col("event_id") / 500))
    each = events.groupBy("user_id", "epoch").agg(F.sum("event_id").alias("a"), F.count("*").alias("n"))
    listed = each.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("epoch", "a", "n"))).alias("e"), F.sum("n").alias("n"), F.max("epoch").alias("last"))
    name, entry = F.concat(F.lit("run_"), F.col("user_id").cast("string")), F.transform("e", lambda x: F.struct(x["epoch"].alias("epoch"), x["a"].alias("loss")))
    flat = F.to_json(F.struct(name.alias("experiment"), F.struct((F.col("user_id") % 4).alias("width")).alias("settings"), F.struct(F.col("n").alias("test_loss")).alias("training"), entry.alias("epoch_metrics")))
    steps = F.transform("e", lambda x: F.struct(x["epoch"].alias("step"), F.struct(x["a"].alias("pretrain loss"), F.array(x["n"], x["n"] + 1).alias("sizes")).alias("losses"), F.lit(True).alias("kept")))
    training = F.struct(F.array(F.lit("streamed"), F.lit("direct")).alias("curriculum"), F.struct(F.col("n").alias("pretrain")).alias("test_losses"), steps.alias("behavior_validation_history"))
    nested = F.to_json(F.struct(name.alias("experiment"), F.struct((F.col("user_id") % 4).alias("embedding_size")).alias("model"), training.alias("training"), F.array().alias("samples")))
    path = files.work_path(spark, "records")
    listed.select(F.when(F.col("user_id") % 2 == 0, flat).otherwise(nested).alias("value")).write.text(path)
    return files.read_records(spark, path, multi_line=False)


RECORDS_SQL = """WITH e AS (SELECT user_id, event_id // 500 AS epoch, sum(event_id)::double AS a, count(*)::double AS n FROM events GROUP BY ALL),
k AS (SELECT *, 'run_' || user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY epoch) - 1 AS i FROM e), u AS (SELECT user_id, run, sum(n) AS n FROM k GROUP BY ALL),
h AS (SELECT *, 'training.behavior_validation_history[' || i || ']' AS p FROM k WHERE user_id % 2 = 1)
"""


@query(RECORDS_SQL + """SELECT run, 'experiment' AS path, NULL::double AS number, run AS text, NULL::boolean AS truth FROM u
UNION ALL SELECT run, CASE WHEN user_id % 2 = 0 THEN 'settings.width' ELSE 'model.embedding_size' END, (user_id % 4)::double, NULL, NULL FROM u
UNION ALL SELECT run, CASE WHEN user_id % 2 = 0 THEN 'training.test_loss' ELSE 'training.test_losses.pretrain' END, n, NULL, NULL FROM u
UNION ALL SELECT run, 'epoch_metrics[' || i || '].epoch', epoch::double, NULL, NULL FROM k WHERE user_id % 2 = 0
UNION ALL SELECT run, 'epoch_metrics[' || i || '].loss', a, NULL, NULL FROM k WHERE user_id % 2 = 0
UNION ALL SELECT run, 'training.curriculum[0]', NULL, 'streamed', NULL FROM u WHERE user_id % 2 = 1 UNION ALL SELECT run, 'training.curriculum[1]', NULL, 'direct', NULL FROM u WHERE user_id % 2 = 1
UNION ALL SELECT run, 'samples', NULL, NULL, NULL FROM u WHERE user_id % 2 = 1 UNION ALL SELECT run, p || '.step', epoch::double, NULL, NULL FROM h
UNION ALL SELECT run, p || '.losses["pretrain loss"]', a, NULL, NULL FROM h UNION ALL SELECT run, p || '.losses.sizes[0]', n, NULL, NULL FROM h
UNION ALL SELECT run, p || '.losses.sizes[1]', n + 1, NULL, NULL FROM h UNION ALL SELECT run, p || '.kept', NULL, NULL, true FROM h""")
def run_values(spark, sf_dir):
    return runs.metric_values(shaped_records(spark, sf_dir), "record")


@query(RECORDS_SQL + """SELECT u.run, (u.user_id % 4)::int AS width, u.n AS test_loss, max(k.epoch)::bigint AS last_step, count(*) AS entries,
  arg_max(CASE WHEN u.user_id % 2 = 0 THEN k.a END, k.epoch) AS last_loss FROM u JOIN k USING (user_id) GROUP BY ALL""")
def run_shapes(spark, sf_dir):
    records = shaped_records(spark, sf_dir)
    columns = {"run": ("string", ["$.experiment"]), "width": ("int", ["$.settings.width", "$.model.embedding_size"]), "test_loss": ("double", ["$.training.test_loss", "$.training.test_losses.pretrain"])}
    history = runs.metric_history(records, "record", ["$.epoch_metrics", "$.training.behavior_validation_history"], {"epoch": "bigint", "step": "bigint", "loss": "double"})
    at = F.coalesce("epoch", "step")
    last = history.groupBy("run").agg(F.max(at).alias("last_step"), F.count("*").alias("entries"), F.max_by("loss", at).alias("last_loss"))
    return runs.metric_columns(records, "record", columns).join(last, "run")


COUNTED = ["seen", "kept", "characters", *[f"rejected_{r}" for r in filters.DOCUMENT_REASONS], "training_documents", "validation_documents", "testing_documents"]


@query(f"""WITH r AS (SELECT t, {s_document_reason('t')} AS reason, {s_split('t', 5, 10)} AS split FROM (SELECT {s_squash('text')} AS t FROM documents)), k AS (SELECT * FROM r WHERE reason IS NULL AND t IS NOT NULL)
SELECT 'seen' AS name, (SELECT count(*) FROM r) AS n UNION ALL SELECT 'kept', count(*) FROM k UNION ALL SELECT 'characters', coalesce(sum(length(t) + 2), 0)::bigint FROM k
""" + "".join(f"UNION ALL SELECT 'rejected_{x}', count(*) FROM r WHERE reason = '{x}' " for x in filters.DOCUMENT_REASONS)
    + "".join(f"UNION ALL SELECT '{x}_documents', count(*) FROM k WHERE split = '{x}' " for x in ("training", "validation", "testing")) + "UNION ALL SELECT 'documents_in_files', count(*) FROM k")
def pretrain_write_counts(spark, sf_dir):
    path = files.work_path(spark, "pretrain")
    docs = table(spark, sf_dir, "documents").select(text.squash(F.col("text")).alias("text"))
    docs = docs.withColumns({"reason": filters.document_reason(F.col("text")), "split": splits.hash_split(F.col("text"))})
    counts = files.write_pretrain_counted(docs, path, filters.DOCUMENT_REASONS)
    counts["documents_in_files"] = files.split_sizes(spark, path).agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    return spark.createDataFrame([(name, int(n)) for name, n in counts.items()], "name string, n bigint")


# Weights and forms of a shuffled cycle; the last form's answers are rejected.
CYCLE = {"region": 2, "customer": 3, "supplier": 1}
CYCLE_FORMS = [("region", 0, "Where is {name}?", "{name} is a country."), ("region", 1, "What is {name}?", "According to the passage, {name}."), ("customer", 0, "Who is {name}?", "{name} is a customer."), ("supplier", 0, "Who is {name}?", "{name} is a supplier.")]
CYCLE_TABLES = {"region": ("nation", "n_nationkey", "n_name"), "customer": ("customer", "c_custkey", "c_name"), "supplier": ("supplier", "s_suppkey", "s_name")}


def cycle_candidates(spark, sf_dir) -> DataFrame:
    """Candidates until there are half as many examples as customers."""
    slots = None
    for category, (name, key, value) in CYCLE_TABLES.items():
        own = ordering.in_order(table(spark, sf_dir, name), [key]).select(F.lit(category).alias("category"), (F.col("rank") - 1).alias("slot"), F.create_map(F.lit("name"), value).alias("values"))
        slots = own if slots is None else slots.unionByName(own)
    forms = spark.createDataFrame(CYCLE_FORMS, "category string, form bigint, prompt string, answer string")
    return templates.until_count(spark, table(spark, sf_dir, "customer").count() // 2, CYCLE, forms, slots)


_PLACES = [(i, c) for i, c in enumerate(c for c, k in CYCLE.items() for _ in range(k))]
CYCLE_SQL = f"""WITH places(s, category) AS (VALUES {", ".join(f"({i}::bigint, '{c}')" for i, c in _PLACES)}), want AS (SELECT count(*) // 2 AS n FROM customer),
orders AS (SELECT b, category, row_number() OVER (PARTITION BY b ORDER BY sha1('0:' || b || ':' || s)) - 1 AS p FROM (SELECT unnest(range((SELECT greatest(20 * n, 10000) // 97 + 1 FROM want))) AS b) x, places),
numbers AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY i) - 1 AS v FROM (SELECT i, category FROM (SELECT unnest(range((SELECT greatest(20 * n, 10000) FROM want))) AS i) x JOIN orders ON b = i // 97 AND p = i % {len(_PLACES)}) x),
slots AS ({" UNION ALL ".join(f"SELECT '{c}' AS category, row_number() OVER (ORDER BY {k}) - 1 AS slot, {v} AS name, count(*) OVER () AS m FROM {t}" for c, (t, k, v) in CYCLE_TABLES.items())}),
forms(category, form, prompt, answer) AS (VALUES {", ".join(f"('{c}', {f}::bigint, {lit(q)}, {lit(a)})" for c, f, q, a in CYCLE_FORMS)}),
full_forms AS (SELECT *, count(*) OVER (PARTITION BY category) AS k FROM forms),
told AS (SELECT i, category, 'User: ' || replace(prompt, '{{name}}', name) || chr(10) || 'Assistant:' AS prompt_text, replace(answer, '{{name}}', name) AS assistant_text
  FROM numbers JOIN slots USING (category) JOIN full_forms USING (category) WHERE slot = v % m AND form = v // m % k),
chats AS (SELECT *, prompt_text || ' ' || assistant_text || {END} AS chat_text, {s_direct('prompt_text', 'assistant_text')} AS reason FROM told),
firsts AS (SELECT category, min(i) AS i, arg_min(chat_text, i) AS chat_text FROM chats WHERE reason IS NULL GROUP BY lower({s_squash('chat_text')}), category),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY i) AS nth FROM firsts) WHERE nth <= (SELECT n FROM want))
"""


@query(CYCLE_SQL + "SELECT 'anchor_' || category || '_' || substr(sha1(chat_text), 1, 24) || '_' || i AS id, category, chat_text FROM kept")
def template_until(spark, sf_dir):
    return templates.template_examples(cycle_candidates(spark, sf_dir), "anchor", "customer.parquet").select("id", "category", "chat_text")


@query(CYCLE_SQL + """, tried AS (SELECT * FROM chats WHERE i <= (SELECT max(i) FROM kept))
SELECT category, count(*) FILTER (WHERE i IN (SELECT i FROM kept)) AS kept, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected, count(*) FILTER (WHERE reason IS NULL AND i NOT IN (SELECT i FROM kept)) AS repeated
FROM tried GROUP BY GROUPING SETS ((category), ())""")
def template_until_counts(spark, sf_dir):
    return templates.counts(cycle_candidates(spark, sf_dir))
