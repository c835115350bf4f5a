"""The library's queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, text
from ..operators import extract, gate, messages, ordering, packing, runs, splits, templates
from ..sources import files, generators
from ..streaming import ingest

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL -------------------------------------------------------------------------------------------------------


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def s_norm(x: str) -> str:
    x = f"translate(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(160) || '“”’‘', ' \"\"''''')"
    return s_strip(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def s_turn(x: str) -> str:
    return f"coalesce(array_to_string(list_filter(list_transform(string_split({s_norm(x)}, chr(10)), lambda z: {s_strip('z')}), lambda z: z <> ''), chr(10)), '')"


def s_squash(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def s_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z0-9'']+'))"


def s_lines(x: str) -> str:
    return f"len(list_filter(string_split({x}, chr(10)), lambda z: {s_strip('z')} <> ''))"


def s_any(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def s_count(x: str, m: str) -> str:
    return f"((length({x}) - length(replace({x}, {lit(m)}, ''))) // {len(m)})"


def s_code(x: str) -> str:
    return f"(contains({x}, '```') OR {s_count(x, '|')} >= 6 OR {' + '.join(s_count(x, m) for m in filters.CODE_MARKERS)} >= 8)"


def s_non_english(x: str) -> str:
    return f"regexp_matches({x}, '[\\x{{0400}}-\\x{{04ff}}\\x{{0600}}-\\x{{06ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]')"


def s_bucket(x: str) -> str:
    return f"(('0x' || substr(sha1({x}), 1, 12))::bigint % 1000)"


def s_split(x: str, a: int, b: int) -> str:
    return f"CASE WHEN {s_bucket(x)} < {a} THEN 'validation' WHEN {s_bucket(x)} < {b} THEN 'testing' ELSE 'training' END"


def s_document_reason(x: str) -> str:
    return f"""CASE WHEN length({x}) < 40 THEN 'short' WHEN length({x}) > 4000 THEN 'long' WHEN {s_any(f'lower({x})', filters.PRETRAIN_PHRASES)} THEN 'phrase'
      WHEN regexp_matches({x}, '(?i)https?://|www\\.') THEN 'url' WHEN {s_non_english(x)} THEN 'non_english' WHEN {s_code(x)} THEN 'code' WHEN {s_words(x)} < 8 THEN 'few_words' END"""


def s_text_reason(x: str, w: filters.TextLimits, prompt: bool) -> str:
    more = f" WHEN {s_any(f'lower({x})', filters.PROMPT_PHRASES)} THEN 'prompt_phrase'" if prompt else ""
    return f"""CASE WHEN coalesce({x}, '') = '' THEN 'empty' WHEN length({x}) > {w.max_chars} THEN 'chars' WHEN NOT {s_words(x)} BETWEEN {w.min_words} AND {w.max_words} THEN 'words'
      WHEN {s_lines(x)} > {w.max_lines} THEN 'lines' WHEN {s_count(x, '#')} >= 3 THEN 'headings' WHEN regexp_matches({x}, '(?i)https?://|www\\.') THEN 'url'
      WHEN regexp_matches({x}, {lit(filters.PLACEHOLDER)}) THEN 'placeholder' WHEN {s_non_english(x)} THEN 'non_english' WHEN {s_code(x)} THEN 'code'
      WHEN {s_any(f'lower({x})', filters.REJECT_PHRASES)} THEN 'phrase'{more} END"""


def s_role(x: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({s_strip(x)}) = '{a}' THEN '{r}'" for a, r in text.ROLES.items()) + " END"


def s_category(u: str, a: str) -> str:
    parts = " ".join(f"WHEN {s_any(f'lower({u})', p)} THEN '{n}'" for n, p in text.CATEGORIES)
    return f"CASE {parts} WHEN NOT contains({a}, chr(10)) AND {s_words(a)} <= 80 THEN 'short_answer' ELSE 'general_chat' END"


# --- documents -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {s_document_reason(s_squash('text'))} AS reason FROM documents")
def pretrain_filter_reasons(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", filters.document_reason(text.squash(F.col("text"))).alias("reason"))


@query(f"SELECT doc_id, {s_split('text', 5, 10)} AS split FROM (SELECT doc_id, {s_squash('text')} AS text FROM documents) WHERE {s_document_reason('text')} IS NULL")
def pretrain_hash_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.squash(F.col("text")).alias("text"))
    return docs.where(filters.document_reason(F.col("text")).isNull()).select("doc_id", splits.hash_split(F.col("text")).alias("split"))


@query(f"""
SELECT source, count(*) AS seen, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected, count(*) FILTER (WHERE reason IS NULL) AS kept,
  coalesce(sum(n) FILTER (WHERE reason IS NULL), 0)::bigint AS characters, count(*) FILTER (WHERE reason IS NULL AND split = 'training') AS training,
  count(*) FILTER (WHERE reason IS NULL AND split = 'validation') AS validation, count(*) FILTER (WHERE reason IS NULL AND split = 'testing') AS testing
FROM (SELECT source, {s_document_reason('text')} AS reason, {s_split('text', 5, 10)} AS split, length(text) + 2 AS n
  FROM (SELECT source, {s_squash('text')} AS text FROM documents)) GROUP BY source""")
def pretrain_funnel_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", text.squash(F.col("text")).alias("text"))
    seen = docs.select("source", filters.document_reason(F.col("text")).isNull().alias("ok"), splits.hash_split(F.col("text")).alias("split"), (F.length("text") + 2).alias("n"))
    return seen.groupBy("source").agg(
        F.count("*").alias("seen"), F.count_if(~F.col("ok")).alias("rejected"), F.count_if("ok").alias("kept"),
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("characters"), *[F.count_if(F.col("ok") & (F.col("split") == name)).alias(name) for name in ("training", "validation", "testing")],
    )


@query(f"SELECT doc_id, sha1({s_norm('text')}) AS normal, sha1({s_squash('text')}) AS squashed FROM documents")
def normalize_text(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.sha1_hex(text.normalize_text(c)).alias("normal"), text.sha1_hex(text.squash(c)).alias("squashed"))


@query(f"SELECT conv_id, turn, {s_turn('text')} AS text, {s_lines('text')} AS lines FROM conversations")
def normalize_turn(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_turn(c).alias("text"), text.line_count(c).alias("lines"))


@query(f"SELECT doc_id, {s_words('text')} AS words, len(regexp_extract_all(text, '\\S+')) AS ws_words, {s_lines('text')} AS lines FROM documents")
def word_line_counts(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(c).alias("words"), text.ws_word_count(c).alias("ws_words"), text.line_count(c).alias("lines"))


@query("SELECT lang, (lower(lang) IN ('en', 'eng', 'english') OR lower(lang) LIKE 'en\\_%' ESCAPE '\\' OR lower(lang) LIKE 'en-%') AS english, count(*) AS n FROM documents GROUP BY ALL")
def language_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("lang", text.is_english(F.col("lang")).alias("english")).groupBy("lang", "english").agg(F.count("*").alias("n"))


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower({s_squash('text')})")
def exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return splits.first_by(docs, F.lower(text.squash(F.col("text"))), "doc_id").select("doc_id", "copies")


@query("""
SELECT doc_id, running FROM (SELECT doc_id, (sum(length(text) + 2) OVER (ORDER BY doc_id))::bigint AS running FROM documents)
WHERE running - 2 <= 1000000""")
def char_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return ordering.char_budget(docs, "doc_id", F.col("n"), 1_000_000).select("doc_id", "running")


@query("SELECT doc_id, CASE doc_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'testing' ELSE 'training' END AS split FROM documents")
def modulo_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", splits.modulo_split(F.col("doc_id")).alias("split"))


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT line, row_number() OVER (ORDER BY sha1('doc ' || doc_id || chr(0) || i || chr(0) || line)) AS r, count(*) OVER () AS n FROM l WHERE len(regexp_extract_all(line, '\\S+')) >= 5)
SELECT CASE WHEN r <= floor(n * 0.8::double) THEN 'training' WHEN r <= floor(n * 0.8::double) + floor(n * 0.1::double) THEN 'validation' ELSE 'testing' END AS split,
  count(*) AS paragraphs, sum(length(line))::bigint AS characters, sum(len(regexp_extract_all(line, '\\S+')))::bigint AS words,
  round(avg(length(line)), 6) AS mean_characters, round(avg(len(regexp_extract_all(line, '\\S+'))), 6) AS mean_words FROM k GROUP BY 1""")
def rank_split_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(text.ws_word_count(F.col("line")) >= 5)
    keyed = lines.withColumn("key", text.sha1_hex(F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit("\0"), F.col("i").cast("string"), F.lit("\0"), "line")))
    keyed = files.saved(keyed, "keyed")  # else it is made for the ranges' bounds as well
    return ordering.rank_split(keyed, "key", ["doc_id", "i"]).groupBy("split").agg(F.count("*").alias("paragraphs"), F.sum(F.length("line")).alias("characters"), F.sum(text.ws_word_count(F.col("line"))).alias("words"), F.round(F.avg(F.length("line")), 6).alias("mean_characters"), F.round(F.avg(text.ws_word_count(F.col("line"))), 6).alias("mean_words"))


@query("""
WITH p AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS i, unnest(c) AS p FROM (SELECT doc_id, regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\\n\\s*\\n') AS c FROM documents))
SELECT doc_id, i AS para, """ + s_squash("p") + " AS text FROM p WHERE " + s_squash("p") + " <> ''")
def paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n \n")).alias("text"))
    return generators.paragraphs(docs, "doc_id", "text")


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS raw FROM documents),
m AS (SELECT doc_id, i, CASE i % 7 WHEN 0 THEN '# ' || raw WHEN 2 THEN '```' WHEN 4 THEN '```' WHEN 5 THEN '' ELSE '- ' || raw END AS line FROM l),
f AS (SELECT *, starts_with(trim(line), '```') AS fence FROM m),
g AS (SELECT *, sum(fence::int) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM f),
t AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(trim(line), '^#{1,6}\\s*', ''), '^([-*+]|\\d+\\.)\\s+', '')) AS s FROM g WHERE NOT fence AND fences % 2 = 0),
k AS (SELECT *, sum((s = '')::int) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM t),
j AS (SELECT doc_id, island, string_agg(s, ' ' ORDER BY i) AS p FROM k WHERE s <> '' GROUP BY doc_id, island)
SELECT doc_id, island::bigint AS island, sha1(p) AS paragraph, len(regexp_extract_all(p, '\\S+')) AS words FROM j WHERE len(regexp_extract_all(p, '\\S+')) >= 5""")
def markdown_paragraphs(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "raw"))
    k = F.pmod("i", F.lit(7))
    marked = F.when(k == 0, F.concat(F.lit("# "), "raw")).when(k.isin(2, 4), "```").when(k == 5, "").otherwise(F.concat(F.lit("- "), "raw"))
    found = generators.markdown_paragraphs(lines.select("doc_id", "i", marked.alias("line")), "doc_id")
    return found.select("doc_id", "island", text.sha1_hex(F.col("paragraph")).alias("paragraph"), text.ws_word_count(F.col("paragraph")).alias("words"))


@query('''
WITH q AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, array_to_string(list_transform(l, lambda z, i: CASE WHEN i % 2 = 0 THEN '"""' || z || '"""' ELSE z END), chr(10)) AS code FROM q),
b AS (SELECT doc_id, unnest(regexp_extract_all(code, '(?s)"""(.*?)"""', 1)) AS block, generate_subscripts(regexp_extract_all(code, '(?s)"""(.*?)"""', 1), 1) - 1 AS n FROM x)
SELECT doc_id, n AS block, ''' + s_squash("replace(block, '`', '')") + ''' AS paragraph FROM b
WHERE NOT starts_with(block, '#') AND len(regexp_extract_all(block, '\\S+')) >= 5''')
def docstring_paragraphs(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    code = F.array_join(F.transform(lines, lambda z, i: F.when(i % 2 == 1, F.concat(F.lit('"""'), z, F.lit('"""'))).otherwise(z)), "\n")
    return generators.docstring_paragraphs(table(spark, sf_dir, "documents").select("doc_id", code.alias("code")), "doc_id", "code")


@query("SELECT token, row_number() OVER (ORDER BY token) AS token_id FROM (SELECT DISTINCT token FROM (SELECT unnest(string_split(text, '')) AS token FROM documents UNION ALL SELECT chr(10)) WHERE token <> '')")
def char_vocab(spark, sf_dir):
    return packing.char_vocab(table(spark, sf_dir, "documents"), "text")


@query("""
WITH s AS (SELECT string_agg(text, chr(30) ORDER BY doc_id) AS s FROM documents),
c AS (SELECT unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) - 1 AS i FROM s),
d AS (SELECT c, i, i // 128 AS w FROM c UNION ALL SELECT c, i, i // 128 - 1 FROM c WHERE i % 128 = 0 AND i > 0),
w AS (SELECT w AS window_id, string_agg(c, '' ORDER BY i) AS x, count(*) AS n FROM d GROUP BY w)
SELECT window_id, sha1(substr(x, 1, 128)) AS input, sha1(substr(x, 2)) AS target, 128 - (length(substr(x, 2)) - length(replace(substr(x, 2), chr(30), ''))) AS loss_targets FROM w WHERE n = 129""")
def lm_windows(spark, sf_dir):
    found = packing.lm_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 128, "\x1e")
    target = F.substring("window", 2, 128)
    return found.select("window_id", text.sha1_hex(F.substring("window", 1, 128)).alias("input"), text.sha1_hex(target).alias("target"), (F.lit(128) - filters.occurrences(target, "\x1e")).alias("loss_targets"))


# --- conversations -------------------------------------------------------------------------------------------------------


@query(f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN {s_text_reason('t', filters.USER, True)} ELSE {s_text_reason('t', filters.ASSISTANT, False)} END AS reason
FROM (SELECT conv_id, turn, role, {s_turn('text')} AS t FROM conversations)""")
def text_usable_reasons(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("t", text.normalize_turn(F.col("text")))
    reason = F.when(F.col("role") == "user", filters.text_reason(F.col("t"), filters.USER, True)).otherwise(filters.text_reason(F.col("t"), filters.ASSISTANT, False))
    return turns.select("conv_id", "turn", reason.alias("reason"))


ALIAS = "CASE turn % 4 WHEN 0 THEN ' Human ' WHEN 1 THEN 'GPT' WHEN 2 THEN role ELSE 'narrator' END"


@query(f"SELECT conv_id, turn, {s_role(ALIAS)} AS role FROM conversations")
def role_alias(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_role(F.expr(ALIAS)).alias("role"))


FLIPPED = "CASE WHEN (conv_id + turn) % 5 = 0 AND role = 'user' THEN 'assistant' WHEN (conv_id + turn) % 5 = 0 AND role = 'assistant' THEN 'user' ELSE role END"


def s_merged(role: str, source: str = "conversations") -> str:
    return f"""
raw AS (SELECT conv_id AS row_id, turn AS pos, {role} AS role, text AS content, count(*) OVER (PARTITION BY conv_id) AS n FROM {source}),
kept AS (SELECT * FROM (SELECT row_id, pos, {s_role('role')} AS role, {s_turn('content')} AS content FROM raw WHERE n >= 2) WHERE role IN ('user', 'assistant') AND content <> ''),
news AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY row_id ORDER BY pos) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM kept),
runs AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY pos) AS i FROM news),
joined AS (SELECT row_id, i, role, string_agg(content, chr(10) ORDER BY pos) AS content FROM runs GROUP BY row_id, i, role),
merged AS (SELECT row_id, i::bigint AS i, role, content FROM (SELECT *, count(*) OVER w AS n, arg_min(role, i) OVER w AS f, bool_or(role = 'assistant') OVER w AS s FROM joined WINDOW w AS (PARTITION BY row_id)) WHERE n >= 2 AND f = 'user' AND s)"""


def turns_of(spark, sf_dir, role: str = "role") -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_id"), F.col("turn").alias("pos"), F.expr(role).alias("role"), F.col("text").alias("content"))


@query(f"WITH {s_merged(FLIPPED)} SELECT * FROM merged")
def merge_role_runs(spark, sf_dir):
    return messages.merge_runs(turns_of(spark, sf_dir, FLIPPED))


@query("SELECT conv_id, turn, (sum((role = 'assistant')::int) OVER (PARTITION BY conv_id ORDER BY turn))::bigint AS assistant_turn FROM conversations")
def turn_index(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "assistant").cast("int")).over(order).alias("assistant_turn"))


WIDE = filters.TextLimits(1, 1000, 10_000, 50)
END = "chr(10) || '<END_ASSISTANT>' || chr(10) || '<CHAT_END>'"


def s_examples(max_index: int, user: filters.TextLimits, assistant: filters.TextLimits, most: int, source: str = "conversations") -> str:
    index = f"AND turn_no <= {max_index}" if max_index else ""
    return f"""WITH {s_merged('role', source)},
seen AS (SELECT *, CASE WHEN role = 'user' THEN {s_text_reason('content', user, True)} ELSE {s_text_reason('content', assistant, False)} END IS NULL AS ok,
  CASE WHEN role = 'user' THEN 'User: ' || content ELSE 'Assistant: ' || content || {END} END AS seg FROM merged),
told AS (SELECT *, bool_and(ok) OVER w AS fine, sum((role = 'assistant')::int) OVER w AS turn_no, lag(content) OVER w AS asked,
  string_agg(seg, chr(10)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || chr(10) || 'Assistant:' AS prompt_text FROM seen WINDOW w AS (PARTITION BY row_id ORDER BY i)),
texts AS (SELECT *, ' ' || content || {END} AS target_text FROM told WHERE fine AND role = 'assistant' AND asked IS NOT NULL AND length(prompt_text) <= {most} {index}),
examples AS (SELECT 'real_chat_conversations_' || substr(sha1(row_id || ':' || turn_no || ':' || prompt_text || target_text), 1, 24) AS id, 'conversations_' || row_id AS dialogue_group,
  'conversations' AS source_group, 'conversations.parquet' AS source_ref, {s_category('asked', 'content')} AS category, prompt_text, content AS assistant_text, target_text,
  prompt_text || target_text AS chat_text, {s_words('prompt_text')} AS prompt_words, {s_words('content')} AS assistant_words FROM texts)"""


DEFAULT_SQL, WIDE_SQL = s_examples(1, filters.USER, filters.ASSISTANT, 1400), s_examples(0, WIDE, WIDE, 20_000)


def wide_examples(spark, sf_dir) -> DataFrame:
    return messages.build_examples(messages.merge_runs(turns_of(spark, sf_dir)), "conversations", "conversations.parquet", 0, WIDE, WIDE, 20_000)


@query(DEFAULT_SQL + " SELECT * FROM examples")
def sft_examples_default(spark, sf_dir):
    return messages.build_examples(messages.merge_runs(turns_of(spark, sf_dir)), "conversations", "conversations.parquet")


@query(WIDE_SQL + " SELECT * FROM examples")
def sft_examples_multiturn(spark, sf_dir):
    return wide_examples(spark, sf_dir)


@query(WIDE_SQL + " SELECT id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha1(id)) AS k FROM examples) WHERE k <= 40 ORDER BY sha1(id) LIMIT 60")
def category_cap(spark, sf_dir):
    return splits.cap(wide_examples(spark, sf_dir), "category", "id", 40, 60).select("id", "category")


@query(WIDE_SQL + f" SELECT id, dialogue_group, {s_split('dialogue_group', 100, 199)} AS split FROM examples")
def group_split(spark, sf_dir):
    return wide_examples(spark, sf_dir).select("id", "dialogue_group", splits.group_split(F.col("dialogue_group"), 0.8, 0.1).alias("split"))


def s_direct(p: str, a: str) -> str:
    return f"""CASE WHEN {p} = '' OR {a} = '' THEN 'empty' WHEN NOT {s_words(a)} BETWEEN 1 AND 90 THEN 'answer_words' WHEN {s_words(p)} > 180 THEN 'prompt_words'
      WHEN {s_any(f'lower({a})', filters.DIRECT_PHRASES)} THEN 'phrase' WHEN {s_non_english(p)} OR {s_non_english(a)} THEN 'non_english' WHEN {s_code(p)} OR {s_code(a)} THEN 'code' END"""


@query(WIDE_SQL + f" SELECT id, {s_direct('prompt_text', 'assistant_text')} AS reason, {s_split('chat_text', 20, 40)} AS split FROM examples")
def direct_filter_split(spark, sf_dir):
    found = wide_examples(spark, sf_dir)
    return found.select("id", filters.direct_reason(F.col("prompt_text"), F.col("assistant_text")).alias("reason"), splits.hash_split(F.col("chat_text"), 20, 20).alias("split"))


@query(WIDE_SQL + f" SELECT split, category, count(*) AS n FROM (SELECT category, {s_split('dialogue_group', 20, 40)} AS split FROM examples) GROUP BY GROUPING SETS ((split), (category), ())")
def manifest_counts(spark, sf_dir):
    rows = wide_examples(spark, sf_dir).select("category", splits.group_split(F.col("dialogue_group")).alias("split"))
    split, category = F.col("split"), F.col("category")
    return rows.groupingSets([[split], [category], []], split, category).agg(F.count("*").alias("n"))


@query(WIDE_SQL + """
SELECT id, status, CASE WHEN ok THEN used END AS prompt_kept, CASE WHEN ok THEN length(target_text) - (used = 0)::int END AS loss_targets,
  CASE WHEN ok THEN sha1(substr(prompt_text, length(prompt_text) - used + 1) || target_text) END AS window_sha1 FROM (
SELECT *, status IN ('kept', 'truncated') AS ok, least(length(prompt_text), 513 - length(target_text)) AS used FROM (
SELECT *, CASE WHEN length(target_text) = 0 THEN 'empty' WHEN length(target_text) >= 513 THEN 'too_long' WHEN length(prompt_text) > 513 - length(target_text) THEN 'truncated' ELSE 'kept' END AS status FROM examples))""")
def sft_windows(spark, sf_dir):
    return packing.sft_windows(wide_examples(spark, sf_dir), 512).withColumn("window_sha1", text.sha1_hex(F.col("window"))).drop("window")


@query(WIDE_SQL + """, n AS (SELECT (SELECT count(*) FROM examples) AS e, (SELECT count(*) FROM documents) AS d)
SELECT event_id AS i, CASE WHEN event_id % 5 < 3 THEN 'sft' ELSE 'pretrain' END AS source,
  CASE WHEN event_id % 5 < 3 THEN ((event_id // 5) * 3 + event_id % 5) % e ELSE ((event_id // 5) * 2 + event_id % 5 - 3) % d END AS index FROM events, n""")
def mixture(spark, sf_dir):
    counts = {"sft": wide_examples(spark, sf_dir).count(), "pretrain": table(spark, sf_dir, "documents").count()}
    return packing.mixture(counts, [("sft", 3), ("pretrain", 2)], table(spark, sf_dir, "events").select(F.col("event_id").alias("i")))


STOPPED = "text || CASE turn % 3 WHEN 0 THEN chr(10) || 'User: more' WHEN 1 THEN '<END_ASSISTANT>' || chr(10) || '<CHAT_END>' ELSE ' !' END"


@query(f"""
SELECT conv_id, turn, has_stop, sha1(t) AS trimmed, sha1(regexp_replace({s_squash('t')}, ' ([.,!?:;])', '\\1', 'g')) AS pretty FROM (
SELECT conv_id, turn, {s_any('x', text.STOPS)} AS has_stop, substr(x, 1, list_min([{', '.join(f"CASE WHEN strpos(x, {lit(s)}) > 0 THEN strpos(x, {lit(s)}) ELSE length(x) + 1 END" for s in text.STOPS)}]) - 1) AS t
FROM (SELECT conv_id, turn, {STOPPED} AS x FROM conversations))""")
def stop_trim(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(STOPPED.replace("chr(10)", "char(10)")).alias("x"))
    t = text.trim_stops(F.col("x"))
    return turns.select("conv_id", "turn", text.has_stop(F.col("x")).alias("has_stop"), text.sha1_hex(t).alias("trimmed"), text.sha1_hex(text.pretty_completion(t)).alias("pretty"))


# --- gate ----------------------------------------------------------------------------------------------------------------


def completions(spark, sf_dir) -> DataFrame:
    """Assistant turns as completions of cases in turn, 44 turns a run; some are given what the gate looks for."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    index = F.expr("cast(turn % 44 div 2 AS int)")
    said = F.expr("CASE conv_id % 6 WHEN 0 THEN concat('Yes! Hello, 2, 4, 7, green blue color john name. ', text) WHEN 1 THEN concat(text, char(10), 'User: hi') WHEN 2 THEN 'la la la la' WHEN 3 THEN concat('the answer is one two one two one two ', text) ELSE text END")
    case = F.element_at(F.array(*[F.lit(c[0]) for c in gate.CASES]), index + 1)
    told = turns.select("conv_id", F.expr("turn div 44").alias("run"), "turn", case.alias("case_id"), said.alias("completion"))
    return told.groupBy("conv_id", "run", "case_id").agg(F.min_by("completion", "turn").alias("completion"))


def s_list(x: list[str]) -> str:
    return "[" + ", ".join(map(lit, x)) + "]::varchar[]"


def s_plain(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({x}, '[^\\x00-\\x7f]', ' ', 'g')), '\\s+', ' ', 'g'))"


GATE_SQL = f"""
WITH c(case_index, case_id, required_any, required_all, forbidden, max_chars) AS (VALUES {', '.join(f'({i}, {lit(c[0])}, {s_list(c[1])}, {s_list(c[2])}, {s_list(c[3])}, {c[4]})' for i, c in enumerate(gate.CASES))}),
t0 AS (SELECT conv_id, turn // 44 AS run, turn, (turn % 44 // 2)::int AS k, CASE conv_id % 6 WHEN 0 THEN 'Yes! Hello, 2, 4, 7, green blue color john name. ' || text WHEN 1 THEN text || chr(10) || 'User: hi'
  WHEN 2 THEN 'la la la la' WHEN 3 THEN 'the answer is one two one two one two ' || text ELSE text END AS completion FROM conversations WHERE role = 'assistant'),
t AS (SELECT conv_id, run, k, arg_min(completion, turn) AS completion FROM t0 GROUP BY ALL),
j AS (SELECT r.conv_id, r.run, c.*, coalesce(t.completion, '') AS x FROM (SELECT DISTINCT conv_id, run FROM t) r CROSS JOIN c LEFT JOIN t ON t.conv_id = r.conv_id AND t.run = r.run AND t.k = c.case_index),
p AS (SELECT *, {s_plain('x')} AS s, {s_strip('x')} AS b FROM j),
w AS (SELECT *, regexp_extract_all(s, '[a-z0-9]+') AS w FROM p),
f AS (SELECT *, list_filter(required_all, lambda z: NOT contains(s, z)) AS missing, list_filter(forbidden, lambda z: contains(s, z)) AS hits,
  len(w) >= 4 AND (len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3])) > 0
    {''.join(f" OR len(list_filter(range(1, greatest(len(w) - {3 * n - 2}, 1)), lambda i: w[i:i + {n - 1}] = w[i + {n}:i + {2 * n - 1}] AND w[i:i + {n - 1}] = w[i + {2 * n}:i + {3 * n - 1}])) > 0" for n in (2, 3, 4))}) AS loop,
  ({' OR '.join(f"starts_with(b, '{m}') OR contains(x, chr(10) || '{m}')" for m in gate.MARKERS)}) AS leak FROM w),
scores AS (SELECT conv_id, run, case_index, case_id, list_filter([CASE WHEN b = '' THEN 'empty_completion' END, CASE WHEN leak THEN 'role_leakage' END, CASE WHEN loop THEN 'repetition_loop' END,
  CASE WHEN max_chars > 0 AND length(x) > max_chars THEN 'too_long' END, CASE WHEN len(required_any) > 0 AND len(list_filter(required_any, lambda z: contains(s, z))) = 0 THEN 'missing_required_any' END,
  CASE WHEN len(missing) > 0 THEN 'missing_required_all' END, CASE WHEN len(hits) > 0 THEN 'forbidden_phrase' END], lambda z: z IS NOT NULL) AS failures, length(x) AS completion_characters FROM f)
"""


@query(GATE_SQL + "SELECT conv_id, run, case_id, array_to_string(failures, ',') AS failures, len(failures) = 0 AS passed, completion_characters FROM scores")
def gate_scores(spark, sf_dir):
    found = gate.suite(completions(spark, sf_dir), gate.cases(spark), ["conv_id", "run"])
    return found.select("conv_id", "run", "case_id", F.array_join("failures", ",").alias("failures"), "passed", "completion_characters")


@query(GATE_SQL + """SELECT conv_id, run, count(*) FILTER (WHERE len(failures) = 0) AS passed_count, count(*) AS total_count, count(*) FILTER (WHERE len(failures) = 0) / count(*) AS pass_rate,
  bool_and(len(failures) = 0) AS passed, coalesce(string_agg(case_id, ',' ORDER BY case_index) FILTER (WHERE len(failures) > 0), '') AS failed_case_ids FROM scores GROUP BY conv_id, run""")
def gate_summary(spark, sf_dir):
    found = gate.summary(gate.suite(completions(spark, sf_dir), gate.cases(spark), ["conv_id", "run"]), ["conv_id", "run"])
    return found.withColumn("failed_case_ids", F.array_join("failed_case_ids", ","))


# --- runs ----------------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0) / 10000, 6) AS mean_loss, round(exp(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0) / 10000), 4) AS perplexity,
  count(*) FILTER (WHERE l_quantity > 0) AS targets FROM lineitem GROUP BY l_returnflag""")
def masked_loss(spark, sf_dir):
    found = runs.masked_loss(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice") / 10000, F.col("l_quantity"))
    return found.withColumns({"mean_loss": F.round("mean_loss", 6), "perplexity": F.round("perplexity", 4)})


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS 4 PRECEDING), 6) AS recent_loss FROM events")
def recent_loss(spark, sf_dir):
    return runs.moving_loss(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value", 5).select("event_id", F.round("recent_loss", 6).alias("recent_loss"))


@query("""SELECT user_id, event_type, (n // 4)::bigint AS update, round(avg(value), 6) AS update_loss, count(*) AS microbatches
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS n FROM events) GROUP BY ALL""")
def update_loss(spark, sf_dir):
    return runs.update_loss(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value", 4).withColumn("update_loss", F.round("update_loss", 6))


HISTORY = "SELECT user_id, event_id AS step, value AS sft_loss, value * 2 AS pretrain_loss, (event_id % 11) / 10.0::double AS pass_rate FROM events"


def history(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("sft_loss"), (F.col("value") * 2).alias("pretrain_loss"), (F.col("event_id") % 11 / 10.0).alias("pass_rate"))


@query(f"SELECT user_id, step, sft_loss, pass_rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pass_rate DESC, sft_loss, step DESC) AS k FROM ({HISTORY})) WHERE k = 1")
def best_record(spark, sf_dir):
    return runs.best_record(history(spark, sf_dir), ["user_id"], "pass_rate", "sft_loss", "step").select("user_id", "step", "sft_loss", "pass_rate")


@query(f"""SELECT user_id, coalesce(arg_min(r, step) FILTER (WHERE r IS NOT NULL), 'max_behavior_updates_reached') AS stop_reason, min(step) FILTER (WHERE r IS NOT NULL) AS stop_step FROM (
  SELECT *, CASE WHEN step >= 100 AND pretrain_loss > 100 * 1.25 THEN 'pretrain_validation_regression' WHEN step >= 100 AND pass_rate >= 0.9 AND sft_loss <= 1.2 THEN 'behavior_gate_passed' END AS r FROM ({HISTORY})) GROUP BY user_id""")
def early_stop(spark, sf_dir):
    return runs.stop_reason(history(spark, sf_dir), ["user_id"], "step", 100, "pretrain_loss", F.lit(100.0), "pass_rate", 0.9, "sft_loss")


EPOCHS = "SELECT user_id, event_type, event_id // 500 AS epoch, count(*) AS microbatches, avg(value) AS mean_loss, max(event_id) AS last_step FROM events GROUP BY ALL"


def epochs(spark, sf_dir) -> DataFrame:
    return runs.stage_metrics(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.floor(F.col("event_id") / 500), "event_id", "value")


@query(f"SELECT * REPLACE (round(mean_loss, 6) AS mean_loss) FROM ({EPOCHS})")
def stage_metrics(spark, sf_dir):
    return epochs(spark, sf_dir).withColumn("mean_loss", F.round("mean_loss", 6))


FINALS = f"SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch DESC) AS k FROM ({EPOCHS})) WHERE k = 1"


@query(f"SELECT * REPLACE (round(mean_loss, 6) AS mean_loss) FROM ({FINALS})")
def final_epoch(spark, sf_dir):
    return runs.final_epoch(epochs(spark, sf_dir), ["user_id", "event_type"]).withColumn("mean_loss", F.round("mean_loss", 6))


@query(f"""SELECT width, count(*) AS runs, round(min(mean_loss), 6) AS best_loss, round(avg(mean_loss), 6) AS mean_loss, count(DISTINCT event_type) <= 1 AS event_type_held, count(DISTINCT seed) <= 1 AS seed_held
  FROM (SELECT *, user_id % 4 AS width, user_id % 4 // 2 AS seed FROM ({FINALS})) GROUP BY width""")
def sweep_table(spark, sf_dir):
    finals = runs.final_epoch(epochs(spark, sf_dir), ["user_id", "event_type"])
    settings = finals.withColumns({"width": F.col("user_id") % 4, "seed": F.floor(F.col("user_id") % 4 / 2)})
    return runs.sweep_table(settings, "width", ["event_type", "seed"], "mean_loss").withColumns({"best_loss": F.round("best_loss", 6), "mean_loss": F.round("mean_loss", 6)})


@query("""SELECT user_id, max(event_id) AS latest_step, arg_max(value, event_id) AS latest_loss, count(*) AS records,
  CASE WHEN max(event_id) >= 900 THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY user_id""")
def run_progress(spark, sf_dir):
    return runs.progress(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 900)


@query("SELECT l_returnflag, count(*) AS microbatches, sum(l_quantity) AS loss_targets FROM lineitem GROUP BY l_returnflag")
def source_totals(spark, sf_dir):
    return runs.source_totals(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


SPECIALS = ["<PAD>", "<UNK>", "<BOS>", "<EOS>"]


@query(f"""WITH c AS (SELECT token, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS token FROM documents) GROUP BY token HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, token) + {len(SPECIALS)} AS token_id FROM c)
SELECT * FROM k WHERE token_id <= 1000 UNION ALL SELECT * FROM (VALUES {', '.join(f"('{t}', NULL, {i + 1})" for i, t in enumerate(SPECIALS))}) AS v(token, frequency, token_id)""")
def frequency_vocab(spark, sf_dir):
    return packing.frequency_vocab(table(spark, sf_dir, "documents"), "text", 1000, SPECIALS)


# --- shapes of raw rows, files and streams -------------------------------------------------------------------------------


def raw_rows(spark, sf_dir) -> DataFrame:
    """Conversations as JSON of three shapes: a list, a list of strings inside a string under other keys, and a pair."""
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    plain = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    inside = F.to_json(F.transform("t", lambda m: F.to_json(F.struct(m["role"].alias("from"), m["text"].alias("value")))))
    ask, answer = F.element_at("t", 1)["text"], F.element_at("t", -1)["text"]
    k = F.col("conv_id") % 3
    row = F.when(k == 0, F.to_json(F.struct(plain.alias("messages")))).when(k == 1, F.to_json(F.struct(inside.alias("conversations")))).otherwise(F.to_json(F.struct(ask.alias("prompt"), answer.alias("response"))))
    return whole.select("conv_id", row.alias("row"))


@query("""SELECT conv_id AS row_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, sha1(text) AS content FROM conversations WHERE conv_id % 3 < 2
UNION ALL SELECT conv_id, 0, 'user', sha1(arg_min(text, turn)) FROM conversations WHERE conv_id % 3 = 2 GROUP BY conv_id
UNION ALL SELECT conv_id, 1, 'assistant', sha1(arg_max(text, turn)) FROM conversations WHERE conv_id % 3 = 2 GROUP BY conv_id""")
def extract_messages(spark, sf_dir):
    found = extract.extract_messages(raw_rows(spark, sf_dir), "conv_id", "row")
    return found.select("row_id", "pos", "role", text.sha1_hex(F.col("content")).alias("content"))


@query(f"SELECT doc_id, sha1(n) AS text FROM (SELECT doc_id, {s_norm('text')} AS n FROM documents)")
def jsonl_round_trip(spark, sf_dir):
    path = files.work_path(spark, "jsonl")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.option("compression", "gzip").json(path)
    back = spark.read.schema("doc_id bigint, text string").option("mode", "FAILFAST").json(path)
    return back.select("doc_id", text.sha1_hex(text.normalize_text(F.col("text"))).alias("text"))


@query(f"""SELECT split, count(*) AS documents, sum(strlen(text))::bigint AS bytes, sum(length(text))::bigint AS characters
FROM (SELECT text, {s_split('text', 5, 10)} AS split FROM (SELECT {s_squash('text')} AS text FROM documents) WHERE {s_document_reason('text')} IS NULL) GROUP BY split""")
def pretrain_files(spark, sf_dir):
    path = files.work_path(spark, "pretrain")
    docs = table(spark, sf_dir, "documents").select(text.squash(F.col("text")).alias("text")).where(filters.document_reason(F.col("text")).isNull())
    files.write_pretrain(docs.withColumn("split", splits.hash_split(F.col("text"))), path)
    return files.split_sizes(spark, path)


def arriving(spark, sf_dir, name: str) -> DataFrame:
    """The table as a stream of its files. A stream's path must be a folder or a pattern, and a table may be one file: so a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(f"SELECT doc_id, {s_split('text', 5, 10)} AS split FROM (SELECT doc_id, {s_squash('text')} AS text FROM documents) WHERE {s_document_reason('text')} IS NULL")
def stream_pretrain(spark, sf_dir):
    path = files.work_path(spark, "stream")
    ingest.append_all(ingest.pretrain_documents(arriving(spark, sf_dir, "documents")).select("doc_id", "text", "split"), path, ["split"])
    return spark.read.parquet(f"{path}/rows").select("doc_id", "split")


@query(f"SELECT DISTINCT sha1(lower({s_squash('text')})) AS key FROM documents")
def stream_dedup(spark, sf_dir):
    path = files.work_path(spark, "stream")
    ingest.append_all(ingest.first_seen(arriving(spark, sf_dir, "documents").select("text")).select("key"), path)
    return spark.read.parquet(f"{path}/rows")


@query(f"SELECT source, split, count(*) AS n FROM (SELECT source, {s_split('text', 5, 10)} AS split FROM (SELECT source, {s_squash('text')} AS text FROM documents) WHERE {s_document_reason('text')} IS NULL) GROUP BY ALL")
def stream_split_counts(spark, sf_dir):
    path = files.work_path(spark, "stream")
    ingest.running_counts(ingest.pretrain_documents(arriving(spark, sf_dir, "documents")), ["source", "split"], path)
    return ingest.latest_counts(spark.read.parquet(f"{path}/counts"), ["source", "split"])


RAW_TURNS = """(SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 < 2
  UNION ALL SELECT conv_id, 0, 'user', arg_min(text, turn) FROM conversations WHERE conv_id % 3 = 2 GROUP BY conv_id
  UNION ALL SELECT conv_id, 1, 'assistant', arg_max(text, turn) FROM conversations WHERE conv_id % 3 = 2 GROUP BY conv_id)"""


@query(f"WITH {s_merged('role', RAW_TURNS)} SELECT * FROM merged")
def import_messages(spark, sf_dir):
    return extract.row_messages(raw_rows(spark, sf_dir), "conv_id", "row")


@query(f"""{s_examples(1, WIDE, WIDE, 20_000, RAW_TURNS)},
r AS (SELECT DISTINCT conv_id, 'shape_' || conv_id % 3 AS source, conv_id % 10 > 0 AS en FROM conversations),
t AS (SELECT r.*, conv_id IN (SELECT row_id FROM merged) AS talk, (SELECT count(*) FROM examples WHERE dialogue_group = 'conversations_' || conv_id) AS n FROM r)
SELECT source, count(*) AS rows_seen, count(*) FILTER (WHERE NOT en) AS non_english_rows, count(*) FILTER (WHERE en AND NOT talk) AS rows_without_messages,
  count(*) FILTER (WHERE en AND talk AND n = 0) AS rows_filtered, count(*) FILTER (WHERE en AND talk AND n > 0) AS rows_kept,
  coalesce(sum(n) FILTER (WHERE en AND talk), 0)::bigint AS examples_kept FROM t GROUP BY source""")
def import_funnel(spark, sf_dir):
    rows = raw_rows(spark, sf_dir).withColumns({"source": F.concat(F.lit("shape_"), F.col("conv_id") % 3), "lang": F.when(F.col("conv_id") % 10 == 0, "fr")})
    talks = files.saved(extract.row_messages(rows, "conv_id", "row"), "messages")
    found = messages.build_examples(talks, "c", "conversations.parquet", 1, WIDE, WIDE, 20_000)
    told = found.select(F.substring("dialogue_group", 3, 40).cast("bigint").alias("row_id"))
    return messages.import_funnel(rows.select(F.col("conv_id").alias("row_id"), "source", "lang"), talks, told, "source", ["lang"])


@query("SELECT conv_id AS row_id, turn AS pos, role, sha1(text) AS content FROM conversations")
def rows_of_files(spark, sf_dir):
    path = files.work_path(spark, "rows")
    turns = table(spark, sf_dir, "conversations").withColumn("part", F.pmod("conv_id", F.lit(3)))
    turns.where("part = 0").drop("part").write.parquet(f"{path}/a.parquet")
    turns.where("part = 1").drop("part").write.option("compression", "gzip").json(f"{path}/b.jsonl")
    listed = turns.where("part = 2").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("rows"))).alias("value"))
    listed.select("value").repartitionById(64, F.pmod(F.hash("value"), F.lit(64))).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(f"{path}/c.json")
    row = F.from_json("row", "conv_id bigint, turn bigint, role string, text string")
    found = files.read_rows(spark, f"{path}/a.parquet", f"{path}/b.jsonl", f"{path}/c.json").select(row.alias("r"))
    return found.select(F.col("r.conv_id").alias("row_id"), F.col("r.turn").alias("pos"), "r.role", text.sha1_hex(F.col("r.text")).alias("content"))


TREE = "SELECT conv_id || '_' || turn AS message_id, CASE WHEN turn = 0 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN 'nowhere' ELSE conv_id || '_' || (turn - 1) END AS parent_id, role, text FROM conversations"


def tree_messages(spark, sf_dir) -> DataFrame:
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("bigint")
    parent = F.when(turn > 0, F.when((F.col("conv_id") + turn) % 7 == 0, "nowhere").otherwise(F.concat(conv, F.lit("_"), (turn - 1).cast("string"))))
    return table(spark, sf_dir, "conversations").select(F.concat(conv, F.lit("_"), turn.cast("string")).alias("message_id"), parent.alias("parent_id"), "role", "text", turn.alias("n"))


@query(f"""WITH RECURSIVE m AS ({TREE}), c AS (
  SELECT message_id AS row_id, 0 AS pos, role, text, parent_id FROM m WHERE role = 'assistant'
  UNION ALL SELECT c.row_id, c.pos - 1, m.role, m.text, m.parent_id FROM c JOIN m ON m.message_id = c.parent_id)
SELECT row_id, pos, role, sha1(text) AS content FROM c""")
def tree_chains(spark, sf_dir):
    return extract.tree_chains(tree_messages(spark, sf_dir), "n").withColumn("content", text.sha1_hex(F.col("content")))


TREE_TURNS = f"""(WITH RECURSIVE m AS ({TREE}), c AS (
  SELECT message_id AS conv_id, 0 AS turn, role, text, parent_id FROM m WHERE role = 'assistant'
  UNION ALL SELECT c.conv_id, c.turn - 1, m.role, m.text, m.parent_id FROM c JOIN m ON m.message_id = c.parent_id)
  SELECT conv_id, turn, role, text FROM c)"""


@query(s_examples(0, WIDE, WIDE, 20_000, TREE_TURNS) + " SELECT * FROM examples")
def tree_examples(spark, sf_dir):
    return messages.build_examples(messages.merge_runs(extract.tree_chains(tree_messages(spark, sf_dir), "n")), "conversations", "conversations.parquet", 0, WIDE, WIDE, 20_000)


@query(f"""WITH {s_merged('role')} SELECT row_id, sha1('System: be kind' || chr(10) || string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content || chr(10), '' ORDER BY i) || 'Assistant: ') AS prompt
FROM merged GROUP BY row_id""")
def plain_prompts(spark, sf_dir):
    found = messages.plain_prompts(messages.merge_runs(turns_of(spark, sf_dir)), "be kind")
    return found.select("row_id", text.sha1_hex(F.col("prompt")).alias("prompt"))


MASKED = "CASE role WHEN 'user' THEN '<U> ' WHEN 'assistant' THEN '<A> ' ELSE '' END || text || CASE role WHEN 'assistant' THEN ' <E> tail' ELSE '' END"


@query(fr"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, '\S+')) AS w, generate_subscripts(regexp_extract_all(x, '\S+'), 1) AS k FROM (SELECT conv_id, turn, {MASKED} AS x FROM conversations)),
m AS (SELECT *, last_value(CASE WHEN w IN ('<U>', '<A>', '<E>') THEN w END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM w)
SELECT conv_id, count(*) AS tokens, sum(CASE WHEN l = '<A>' AND w NOT IN ('<U>', '<A>') THEN 1 ELSE 0 END)::bigint AS loss_targets,
  sha1(string_agg(CASE WHEN l = '<A>' AND w NOT IN ('<U>', '<A>') THEN '1' ELSE '0' END, '' ORDER BY turn, k)) AS mask FROM m GROUP BY conv_id""")
def assistant_mask(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(MASKED).alias("x"))
    words = turns.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("x", F.lit(r"\S+"), 0)).alias("k", "w")).select("conv_id", F.struct("turn", "k").alias("pos"), "w")
    found = packing.assistant_mask(words, "conv_id", "pos", "w", F.lit("<A>"), F.lit("<U>"), F.lit("<E>"))
    mask = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "loss"))), lambda x: x["loss"].cast("string")), "")
    return found.groupBy("conv_id").agg(F.count("*").alias("tokens"), F.sum("loss").alias("loss_targets"), text.sha1_hex(mask).alias("mask"))


@query("""WITH v AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents WHERE lang = 'en' UNION SELECT chr(10)) WHERE token <> ''),
c AS (SELECT doc_id, c, i FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents) WHERE c <> '')
SELECT doc_id, count(*) AS n, sum(coalesce(id, 1))::bigint AS id_sum, sha1(string_agg(coalesce(token, (SELECT token FROM v WHERE id = 1)), '' ORDER BY i)) AS decoded FROM c LEFT JOIN v ON token = c GROUP BY doc_id""")
def char_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    vocab = files.saved(packing.char_vocab(docs.where("lang = 'en'"), "text"), "vocab")
    coded = files.saved(packing.encode(docs, "text", vocab).select("doc_id", "ids"), "ids")
    found = packing.decode(coded.where(F.size("ids") > 0), "ids", vocab)
    return found.select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"), text.sha1_hex(F.col("decoded")).alias("decoded"))


@query("""SELECT (w // 8)::bigint AS batch_id, count(*) AS windows, min(w)::bigint AS first_window FROM (SELECT unnest(range((greatest(sum(length(text)) + count(*) - 2, 0) // 128)::bigint)) AS w FROM documents) GROUP BY 1""")
def lm_batches(spark, sf_dir):
    found = packing.batches(packing.lm_windows(table(spark, sf_dir, "documents"), "doc_id", "text", 128, "\x1e"), "window_id", 8)
    return found.groupBy("batch_id").agg(F.count("*").alias("windows"), F.min("window_id").alias("first_window"))


@query("""SELECT source, count(*) AS lines, sum(length(text))::bigint AS characters, round(avg(length(text)), 6) AS mean_characters, (sum(length(text)) + count(*) - 1)::bigint AS stream_length,
  greatest((sum(length(text)) + count(*) - 2) // 48, 0)::bigint AS windows FROM documents GROUP BY source""")
def token_stream_stats(spark, sf_dir):
    return packing.stream_stats(table(spark, sf_dir, "documents"), ["source"], F.length("text"), 48).withColumn("mean_characters", F.round("mean_characters", 6))


@query(WIDE_SQL + " SELECT id, category FROM examples ORDER BY sha1('7|' || id), id LIMIT 25")
def audit_sample(spark, sf_dir):
    return packing.audit_sample(wide_examples(spark, sf_dir), "id", 25, "7").select("id", "category")


@query(WIDE_SQL + """ (SELECT 'pretrain' AS source, sha1(text) AS text FROM documents ORDER BY doc_id LIMIT 75) UNION ALL (SELECT 'sft', sha1(chat_text) FROM examples ORDER BY sha1(id) LIMIT 25)""")
def vocabulary_sample(spark, sf_dir):
    chats = wide_examples(spark, sf_dir).withColumn("h", text.sha1_hex(F.col("id")))
    found = packing.vocabulary_sample(table(spark, sf_dir, "documents"), "doc_id", "text", chats, "h", "chat_text", 100)
    return found.select("source", text.sha1_hex(F.col("text")).alias("text"))


@query(WIDE_SQL + f""", d AS (SELECT * FROM (SELECT {s_squash('text')} AS text FROM documents) WHERE {s_document_reason('text')} IS NULL)
SELECT 'pretrain' AS kind, {s_split('text', 5, 10)} AS key, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'sft', {s_split('dialogue_group', 20, 40)}, count(*) FROM examples GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM examples GROUP BY 2""")
def manifest_file(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(text.squash(F.col("text")).alias("text")).where(filters.document_reason(F.col("text")).isNull())
    found = wide_examples(spark, sf_dir).select("category", splits.group_split(F.col("dialogue_group")).alias("split"))
    each = found.select(F.explode(F.create_map(F.lit("sft"), "split", F.lit("category"), "category")).alias("kind", "key"))
    rows = docs.select(F.lit("pretrain").alias("kind"), splits.hash_split(F.col("text")).alias("key")).unionByName(each)
    path = files.work_path(spark, "manifest")
    files.write_manifest(rows.groupBy("kind", "key").agg(F.count("*").alias("n")), path, {"table": "documents"})
    return files.read_manifest(spark, path)


METRICS = "experiment bigint, settings struct<width: bigint>, training struct<test_loss: double, final_step: bigint>, epoch_metrics array<struct<epoch: bigint, train_loss: double>>"


@query("""WITH e AS (SELECT user_id, event_id // 500 AS epoch, avg(value) / 100 AS train_loss FROM events GROUP BY ALL),
f AS (SELECT user_id, max(epoch) AS epochs, arg_max(train_loss, epoch) AS train_loss FROM e GROUP BY user_id),
t AS (SELECT user_id, avg(value) / 100 AS test_loss, max(event_id) AS final_step FROM events GROUP BY user_id),
s AS (SELECT user_id, CASE event_id % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'testing' ELSE 'training' END AS split, count(*) AS lines, (sum(length(props)) + count(*) - 1)::bigint AS stream_length FROM events GROUP BY ALL)
SELECT user_id AS experiment, user_id % 4 AS width, epochs, round(train_loss, 6) AS train_loss, round(exp(train_loss), 5) AS train_perplexity, round(test_loss, 6) AS test_loss, round(exp(test_loss), 5) AS test_perplexity, final_step,
  """ + ", ".join(f"(SELECT {c} FROM s WHERE s.user_id = f.user_id AND split = '{p}') AS {p}_{c}" for p in ("training", "validation", "testing") for c in ("lines", "stream_length")) + """
FROM f JOIN t USING (user_id)""")
def run_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    by_epoch = events.groupBy("user_id", F.floor(F.col("event_id") / 500).alias("epoch")).agg((F.avg("value") / 100).alias("train_loss"))
    listed = by_epoch.groupBy("user_id").agg(F.collect_list(F.struct("epoch", "train_loss")).alias("epoch_metrics"))
    last = events.groupBy("user_id").agg(F.struct((F.avg("value") / 100).alias("test_loss"), F.max("event_id").alias("final_step")).alias("training"))
    path = files.work_path(spark, "metrics")
    records = listed.join(last, "user_id").select(F.col("user_id").alias("experiment"), F.struct((F.col("user_id") % 4).alias("width")).alias("settings"), "training", "epoch_metrics")
    records.write.json(path)
    stats = packing.stream_stats(events.withColumn("split", splits.modulo_split(F.col("event_id"))), ["user_id", "split"], F.length("props"), 48).withColumnRenamed("user_id", "experiment")
    found = runs.run_summary(files.read_metrics(spark, path, METRICS, multi_line=False), stats)
    return found.withColumns({c: F.round(c, 5 if c.endswith("perplexity") else 6) for c in ("train_loss", "train_perplexity", "test_loss", "test_perplexity")})


FORMS = [("region", 0, "Where is {nation}?", "{nation} is in {region}."), ("region", 1, "Is {nation} in {region}? Keep it simple.", "Yes."), ("supplier", 0, "Who is {name}?", "{name} is a supplier.")]


TEMPLATE_SQL = f"""WITH n AS (SELECT (event_id // 3)::bigint AS c, event_id % 3 AS p, event_id AS i FROM events),
g AS (SELECT i, CASE WHEN p < 2 THEN 'region' ELSE 'supplier' END AS category, CASE WHEN p < 2 THEN c * 2 + p ELSE c END AS v FROM n),
r AS (SELECT n_name, r_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS slot, count(*) OVER () AS m FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS slot, count(*) OVER () AS m FROM supplier),
x AS (SELECT i, category, CASE WHEN (v // m) % 2 = 0 THEN 'Where is ' || n_name || '?' ELSE 'Is ' || n_name || ' in ' || r_name || '? Keep it simple.' END AS q, CASE WHEN (v // m) % 2 = 0 THEN n_name || ' is in ' || r_name || '.' ELSE 'Yes.' END AS assistant_text
    FROM g JOIN r ON v % m = slot WHERE category = 'region' UNION ALL SELECT i, category, 'Who is ' || s_name || '?', s_name || ' is a supplier.' FROM g JOIN s ON v % m = slot WHERE category = 'supplier'),
y AS (SELECT i, category, 'User: ' || q || chr(10) || 'Assistant:' AS prompt_text, assistant_text FROM x),
y2 AS (SELECT *, prompt_text || ' ' || assistant_text || {END} AS chat_text, {s_direct('prompt_text', 'assistant_text')} AS reason FROM y)
"""


def candidates(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lands = nations.select(F.lit("region").alias("category"), (F.row_number().over(Window.orderBy("n_nationkey")) - 1).cast("bigint").alias("slot"), F.create_map(F.lit("nation"), "n_name", F.lit("region"), "r_name").alias("values"))  # 25 rows
    numbered = ordering.in_order(table(spark, sf_dir, "supplier"), ["s_suppkey"])
    names = numbered.select(F.lit("supplier").alias("category"), (F.col("rank") - 1).alias("slot"), F.create_map(F.lit("name"), "s_name").alias("values"))
    forms = spark.createDataFrame(FORMS, "category string, form bigint, prompt string, answer string")
    return templates.candidates(table(spark, sf_dir, "events"), "event_id", {"region": 2, "supplier": 1}, forms, lands.unionByName(names))


@query(TEMPLATE_SQL + f"""SELECT 'anchor_' || category || '_' || substr(sha1(arg_min(chat_text, i)), 1, 24) || '_' || min(i) AS id, category, arg_min(chat_text, i) AS chat_text FROM y2 WHERE reason IS NULL GROUP BY lower({s_squash('chat_text')}), category""")
def template_examples(spark, sf_dir):
    return templates.template_examples(candidates(spark, sf_dir), "anchor", "events.parquet").select("id", "category", "chat_text")


@query(TEMPLATE_SQL + f"""SELECT category, count(DISTINCT k) AS kept, count(*) FILTER (WHERE k IS NULL) AS rejected, count(k) - count(DISTINCT k) AS repeated
FROM (SELECT category, CASE WHEN reason IS NULL THEN lower({s_squash('chat_text')}) END AS k FROM y2) GROUP BY GROUPING SETS ((category), ())""")
def template_counts(spark, sf_dir):
    return templates.counts(candidates(spark, sf_dir))


@query(WIDE_SQL + """ SELECT id, status, used AS prompt_kept, length(target_text) - (used = 0)::int AS loss_targets, sha1(substr(prompt_text, length(prompt_text) - used + 1) || target_text) AS window_sha1 FROM (
SELECT *, CASE WHEN length(prompt_text) > 513 - length(target_text) THEN 'truncated' ELSE 'kept' END AS status, least(length(prompt_text), 513 - length(target_text)) AS used FROM examples WHERE length(target_text) BETWEEN 1 AND 512)""")
def stream_sft_windows(spark, sf_dir):
    path = files.work_path(spark, "stream")
    wide_examples(spark, sf_dir).write.json(f"{path}/in")
    found = ingest.supervised_windows(spark.readStream.schema(files.SFT_SCHEMA).json(f"{path}/in"), 512)
    ingest.append_all(found.withColumn("window_sha1", text.sha1_hex(F.col("window"))).drop("window"), path)
    return spark.read.parquet(f"{path}/rows")


@query("SELECT doc_id, substr(text, 1, 60) AS prefix FROM documents WHERE regexp_matches(text, '\\S') ORDER BY doc_id LIMIT 20")
def prompt_prefixes(spark, sf_dir):
    return packing.prompt_prefixes(table(spark, sf_dir, "documents"), "doc_id", "text", 20, 60)


@query(SQL["lm_windows"].rsplit("SELECT window_id", 1)[0] + """SELECT (SELECT length(s) FROM s) AS stream_length, (SELECT (length(s) - 1) // 128 FROM s) AS candidates, count(*) AS windows,
  sum(128 - (length(substr(x, 2)) - length(replace(substr(x, 2), chr(30), ''))))::bigint AS loss_targets FROM w WHERE n = 129""")
def lm_window_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.lm_stats(packing.lm_windows(docs, "doc_id", "text", 128, "\x1e"), "\x1e", docs, "text", 128)


@query(WIDE_SQL + """, w AS (SELECT *, CASE WHEN length(target_text) = 0 THEN 'empty' WHEN length(target_text) >= 513 THEN 'too_long' WHEN length(prompt_text) > 513 - length(target_text) THEN 'truncated' ELSE 'kept' END AS status,
  least(length(prompt_text), 513 - length(target_text)) AS used FROM examples), o AS (SELECT *, status IN ('kept', 'truncated') AS ok FROM w)
SELECT count(*) FILTER (WHERE ok) AS kept, ceil(count(*) FILTER (WHERE ok) / 8)::bigint AS batches, count(*) FILTER (WHERE status = 'too_long') AS too_long, count(*) FILTER (WHERE status = 'empty') AS empty,
  count(*) FILTER (WHERE status = 'truncated') AS truncated, (sum(length(target_text) - (used = 0)::int) FILTER (WHERE ok))::bigint AS loss_targets, round(avg(used) FILTER (WHERE ok), 6) AS mean_prompt, round(avg(length(target_text)) FILTER (WHERE ok), 6) AS mean_target FROM o""")
def sft_window_stats(spark, sf_dir):
    found = packing.sft_windows(wide_examples(spark, sf_dir), 512)
    told = packing.sft_stats(found, F.length("window") - F.col("prompt_kept"), 8)
    return told.withColumns({"mean_prompt": F.round("mean_prompt", 6), "mean_target": F.round("mean_target", 6)})


@query(SQL["docstring_paragraphs"].split("SELECT doc_id, n AS block")[0] + ", c AS (SELECT doc_id, " + s_squash("replace(block, '`', '')") + """ AS p FROM b WHERE NOT starts_with(block, '#') AND len(regexp_extract_all(block, '\\S+')) >= 5)
SELECT d.doc_id, length(d.text) AS raw_characters, coalesce(k.n, 0) AS paragraphs, coalesce(k.m, 0)::bigint AS characters FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(p)) AS m FROM c GROUP BY doc_id) k USING (doc_id)""")
def file_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    clean = docstring_paragraphs(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("paragraph")).alias("m"))
    told = docs.select("doc_id", F.length("text").alias("raw_characters")).join(clean, "doc_id", "left")
    return told.select("doc_id", "raw_characters", F.coalesce("n", F.lit(0)).alias("paragraphs"), F.coalesce("m", F.lit(0)).alias("characters"))
