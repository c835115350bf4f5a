"""The behaviour gate: scores of completions against cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Id, required_any, required_all, forbidden, max_completion_characters of the cases.
CASES = [
    ("greeting", ["hi", "hello", "help"], [], [], 500),
    ("arithmetic_one_plus_one", ["2", "two"], [], [], 300),
    ("arithmetic_two_plus_two", ["4", "four"], [], [], 300),
    ("arithmetic_three_plus_four_symbol", ["7", "seven"], [], [], 300),
    ("green_is_color", [], ["yes", "green", "color"], [], 300),
    ("blue_is_color", [], ["yes", "blue", "color"], [], 300),
    ("name_statement_ack", ["alex"], [], ["color", "capital", "answer is"], 300),
    ("name_recall", ["alex"], [], [], 300),
    ("usa_democracy", ["democracy", "democratic", "constitutional republic"], [], [], 500),
    ("france_capital", ["paris"], [], [], 300),
    ("japan_capital", ["tokyo"], [], [], 300),
    ("japan_capital_lowercase", ["tokyo"], [], [], 300),
    ("canada_capital_lowercase", ["ottawa"], [], [], 300),
    ("plato_fact", ["plato", "philosopher", "greek"], [], ["answer is", "capital of"], 500),
    ("car_wheels", ["4", "four"], ["wheel"], ["seven days", "capital"], 400),
    ("meaning_of_life", ["meaning", "purpose", "people", "depends", "different"], [], ["capital of", "answer is"], 600),
    ("private_unknown", ["do not know", "don't know", "not know", "tell me"], [], ["capital", "answer is"], 500),
    ("kind_rewrite", ["reminder", "remember", "check", "when you have a chance", "could you"], [], ["you forgot again"], 500),
    ("simple_dinner_ideas", ["dinner", "pasta", "rice", "eggs", "salad", "soup", "tacos", "sandwich", "potato", "omelet"], [], [], 600),
    ("john_is_name", ["yes"], ["john", "name"], [], 300),
    ("john_is_name_lowercase", ["yes"], ["john", "name"], [], 300),
    ("cats_chat", ["cat", "cats"], [], ["capital", "answer is"], 400),
]
# What each case asks.
PROMPTS = {
    "greeting": "User: hello\nAssistant:",
    "arithmetic_one_plus_one": "User: what is 1 plus 1?\nAssistant:",
    "arithmetic_two_plus_two": "User: what is 2 plus 2?\nAssistant:",
    "arithmetic_three_plus_four_symbol": "User: what is 3+4?\nAssistant:",
    "green_is_color": "User: is green a color?\nAssistant:",
    "blue_is_color": "User: is blue a color?\nAssistant:",
    "name_statement_ack": "User: My name is Alex.\nAssistant:",
    "name_recall": "User: my name is alex.\nAssistant: Nice to meet you, Alex.\n<END_ASSISTANT>\n<CHAT_END>\nUser: what is my name?\nAssistant:",
    "usa_democracy": "User: I live in the USA. Is the USA a democracy or a dictatorship?\nAssistant:",
    "france_capital": "User: what is the capital of France?\nAssistant:",
    "japan_capital": "User: what is the capital of Japan?\nAssistant:",
    "japan_capital_lowercase": "User: what is the capital of japan?\nAssistant:",
    "canada_capital_lowercase": "User: what is the capital of canada?\nAssistant:",
    "plato_fact": "User: Who was Plato?\nAssistant:",
    "car_wheels": "User: How many wheels on a car?\nAssistant:",
    "meaning_of_life": "User: What is the meaning of life?\nAssistant:",
    "private_unknown": "User: What is my favorite food?\nAssistant:",
    "kind_rewrite": "User: rewrite this kindly: You forgot again.\nAssistant:",
    "simple_dinner_ideas": "User: give me two simple dinner ideas.\nAssistant:",
    "john_is_name": "User: is John a name?\nAssistant:",
    "john_is_name_lowercase": "User: is john a name?\nAssistant:",
    "cats_chat": "User: I like cats\nAssistant:",
}
MARKERS = ["User:", "Assistant:", "System:"]


def cases(spark: SparkSession) -> DataFrame:
    rows = [(i, *c, PROMPTS[c[0]]) for i, c in enumerate(CASES)]
    return spark.createDataFrame(rows, "case_index int, case_id string, required_any array<string>, required_all array<string>, forbidden array<string>, max_chars int, prompt string")


def open_prompts(completions: DataFrame, case_table: DataFrame, by: list[str]) -> DataFrame:
    """(by, case_id, prompt): what each run has still to answer."""
    asked = completions.select(*by).distinct().crossJoin(F.broadcast(case_table.select("case_id", "prompt")))  # so many cases a run
    return asked.join(completions.select(*by, "case_id"), [*by, "case_id"], "left_anti")


def plain(c: Column) -> Column:
    """Non-ASCII characters to spaces, A-Z to lower case, white space squashed."""
    lowered = F.translate(F.regexp_replace(c, "[^\\x00-\\x7f]", " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lowered, r"\s+", " "), "^ | $", "")


def role_leakage(c: Column) -> Column:
    found = F.lit(False)
    for m in MARKERS:
        found = found | strip(c).startswith(m) | c.contains("\n" + m)
    return found


def repetition_loop(c: Column) -> Column:
    """Four equal words in a row, or two to four words three times in a row, among four words at least."""
    words = F.regexp_extract_all(plain(c), F.lit("([a-z0-9]+)"), 1)
    said = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return (F.size(words) >= 4) & (said.rlike(r"( [a-z0-9]+)\1\1\1(?= )") | said.rlike(r"((?: [a-z0-9]+){2,4})\1\1(?= )"))


def scored(completions: DataFrame) -> DataFrame:
    """Rows with the cases' columns and `completion` -> failures (in order), passed, completion_characters, missing_required_all,
    forbidden_hits. A null completion is empty; an empty phrase is present."""
    text = F.coalesce("completion", F.lit(""))
    said = plain(text)
    present = lambda p: said.contains(plain(p))
    missing = F.filter("required_all", lambda p: ~present(p))
    hits = F.filter("forbidden", present)
    tests = [
        ("empty_completion", strip(text) == ""), ("role_leakage", role_leakage(text)), ("repetition_loop", repetition_loop(text)), ("too_long", (F.col("max_chars") > 0) & (F.length(text) > F.col("max_chars"))),
        ("missing_required_any", (F.size("required_any") > 0) & ~F.exists("required_any", present)), ("missing_required_all", F.size(missing) > 0), ("forbidden_phrase", F.size(hits) > 0),
    ]
    failures = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    out = completions.withColumns({"failures": failures, "completion_characters": F.length(text), "missing_required_all": missing, "forbidden_hits": hits})
    return out.withColumn("passed", F.size("failures") == 0)


def suite(completions: DataFrame, case_table: DataFrame, by: list[str], first: int = 0) -> DataFrame:
    """All cases for each run (by) with its completions (by, case_id, completion), scored; a missing completion is empty. first: only so
    many cases (0: all)."""
    case_table = case_table.where(F.col("case_index") < first) if first else case_table
    runs = completions.select(*by).distinct()
    return scored(runs.crossJoin(F.broadcast(case_table)).join(completions, [*by, "case_id"], "left"))  # so many cases a run


def summary(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count_if("passed").alias("passed_count"), F.count("*").alias("total_count"), (F.count_if("passed") / F.count("*")).alias("pass_rate"), F.every("passed").alias("passed"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.struct("case_index", "case_id")))), lambda x: x["case_id"]).alias("failed_case_ids"),
    )
