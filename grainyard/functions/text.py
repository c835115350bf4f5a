"""Text normalisation and scalar functions: Column -> Column, all inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases of roles.
ROLES = {
    "user": "user", "human": "user", "prompter": "user", "customer": "user", "client": "user",
    "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "chatbot": "assistant", "model": "assistant",
    "system": "system",
}
# Markers of rendered conversations, and where chat completions stop.
END_ASSISTANT, CHAT_END = "<END_ASSISTANT>", "<CHAT_END>"
STOPS = [END_ASSISTANT, CHAT_END, "\nUser:", "\nAssistant:", "\nSystem:"]
# What tells prompt categories, in order.
CATEGORIES = [
    ("greeting", ["hello", "hi ", "hey", "good morning"]),
    ("rewrite", ["rewrite", "rephrase", "make this", "sound kinder", "polite"]),
    ("planning", ["plan", "ideas", "brainstorm", "suggest"]),
    ("factual", ["what is", "who is", "where is", "capital", "how many"]),
]


def once(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c) with c computed once a row. Written plainly, Spark puts c's expression wherever fn names it when it moves a filter below
    a projection or joins two projections."""
    return F.element_at(F.transform(F.array(c), fn), 1)


#: Unicode white space but the plain space, as ranges inside a class: the flag that makes \s mean the same looks properties up for each character.
_WIDE = r"\t-\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[ {_WIDE}]+|[ {_WIDE}]+$", "")


def normalize_text(c: Column) -> Column:
    c = F.translate(F.regexp_replace(c, "\r\n?", "\n"), " “”’‘", " \"\"''")
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def normalize_turn(c: Column) -> Column:
    lines = F.transform(F.split(normalize_text(c), "\n", -1), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def squash(c: Column) -> Column:
    """White space runs to one space, none at the ends. Single spaces, most of a text's white space, are no match."""
    return F.trim(F.regexp_replace(c, f"[{_WIDE}][ {_WIDE}]*| [ {_WIDE}]+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z0-9']+"))


def ws_word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^ {_WIDE}]+"))


def line_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n", -1), lambda x: strip(x) != ""))


def sha1_hex(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def sha1_int(c: Column) -> Column:
    return F.conv(F.substring(sha1_hex(c), 1, 12), 16, 10).cast("bigint")


def normalize_role(c: Column) -> Column:
    """The role behind an alias; null for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.try_element_at(table, F.lower(strip(c)))


def is_english(*languages: Column) -> Column:
    """The first language that isn't null decides; none: true."""
    lang = F.lower(strip(F.coalesce(*languages)))
    return F.coalesce(lang.isin("en", "eng", "english") | lang.startswith("en_") | lang.startswith("en-"), F.lit(True))


def any_of(c: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | c.contains(p)
    return found


def prompt_category(user: Column, assistant: Column) -> Column:
    lowered, out = F.lower(user), None
    for name, phrases in CATEGORIES:
        out = F.when(any_of(lowered, phrases), name) if out is None else out.when(any_of(lowered, phrases), name)
    return out.when(~assistant.contains("\n") & (word_count(assistant) <= 80), "short_answer").otherwise("general_chat")


def trim_stops(c: Column, stops: list[str] = STOPS) -> Column:
    """The text up to the first stop string."""
    at = F.least(*[F.when(F.instr(c, s) > 0, F.instr(c, s)) for s in stops], F.length(c) + 1)
    return F.substring(c, F.lit(1), at - 1)


def has_stop(c: Column, stops: list[str] = STOPS, ids: Column | None = None, eos: int | None = None) -> Column:
    """Whether a stop string is in the text or, with ids, the last of them is the end of the sequence."""
    found = any_of(c, stops)
    return found if ids is None else found | F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False))


def pretty_completion(c: Column, brackets: bool = False) -> Column:
    """White space squashed, none before punctuation; with brackets none inside them either."""
    c = F.regexp_replace(squash(c), r" ([.,!?:;])", "$1")
    return F.replace(F.replace(c, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")")) if brackets else c
