"""Filters as reasons: the first test that a text fails, null if it passes all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, line_count, once, word_count

# Patterns, markers and phrase lists of the filters.
NON_ENGLISH = "[Ѐ-ӿ؀-ۿ一-鿿぀-ヿ가-힯]"
URL = r"(?i)https?://|www\."
PLACEHOLDER = r"(?i)\[(?:name|address|email|phone|date|company|insert|recipient|sender|city|state|country|link|url)[^\]]*\]"
CODE_MARKERS = ["{", "}", ";", "</", "/>", "=>", "::"]
PRETRAIN_PHRASES = [
    "javascript", "cookie policy", "privacy policy", "terms of service", "subscribe to", "click here", "all rights reserved",
    "function ", "import ", "public static",
]
REJECT_PHRASES = [
    "as an ai language model", "as an ai", "i am an ai language model", "i'm an ai language model", "i do not have feelings",
    "i don't have feelings", "i do not have emotions", "i don't have emotions", "i cannot generate inappropriate",
    "i can't generate inappropriate", "cannot generate inappropriate content", "ignore previous instructions", "jailbreak",
    "prompt injection", "bypass", "no-rules", "no rules", "no restrictions", "actdan", "bedan", "simulateinternet",
    "bypassoapolicy", "oadhere", "stay in character", "makeupinfo", "self-harm", "suicide", "erotic", "porn", "ransomware",
    "phishing",
]
PROMPT_PHRASES = [
    "write a facebook post", "write a blog post", "write a comprehensive", "write an essay", "at least 1000 words", "role:dan",
    "dan≠", "dan ≠", "hcgpt", "bypass", "jailbreak", "ignore previous instructions", "stay in character",
]
DIRECT_PHRASES = [
    "as an ai language model", "according to the passage", "provided text", "[name]", "[address]", "user:", "assistant:", "system:",
]


@dataclass(frozen=True)
class TextLimits:
    min_words: int = 1
    max_words: int = 100
    max_chars: int = 900
    max_lines: int = 8


USER, ASSISTANT = TextLimits(max_chars=800, max_lines=4), TextLimits()


def occurrences(c: Column, marker: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def code_heavy(c: Column) -> Column:
    markers = sum((occurrences(c, m) for m in CODE_MARKERS), F.lit(0))
    return c.contains("```") | (occurrences(c, "|") >= 6) | (markers >= 8)


def non_english(c: Column) -> Column:
    return c.rlike(NON_ENGLISH)


DOCUMENT_REASONS = ("short", "long", "phrase", "url", "non_english", "code", "few_words")


def document_reason(c: Column) -> Column:
    """Why a paragraph is no pretraining document: short, long, phrase, url, non_english, code or few_words."""
    return once(c, lambda t: (
        F.when(F.length(t) < 40, "short").when(F.length(t) > 4000, "long").when(once(F.lower(t), lambda x: any_of(x, PRETRAIN_PHRASES)), "phrase")
        .when(t.rlike(URL), "url").when(non_english(t), "non_english").when(code_heavy(t), "code").when(word_count(t) < 8, "few_words")
    ))


def text_reason(c: Column, limits: TextLimits, is_prompt: bool) -> Column:
    """Why a turn is not usable."""
    return once(c, lambda t: _text_reason(t, limits, is_prompt))


def _text_reason(c: Column, limits: TextLimits, is_prompt: bool) -> Column:
    lowered, words = F.lower(c), word_count(c)
    reason = (
        F.when(F.coalesce(c, F.lit("")) == "", "empty").when(F.length(c) > limits.max_chars, "chars").when(~words.between(limits.min_words, limits.max_words), "words")
        .when(line_count(c) > limits.max_lines, "lines").when(occurrences(c, "#") >= 3, "headings").when(c.rlike(URL), "url").when(c.rlike(PLACEHOLDER), "placeholder")
        .when(non_english(c), "non_english").when(code_heavy(c), "code").when(any_of(lowered, REJECT_PHRASES), "phrase")
    )
    return reason.when(any_of(lowered, PROMPT_PHRASES), "prompt_phrase") if is_prompt else reason


def direct_reason(prompt: Column, answer: Column) -> Column:
    """Why an example is no direct answer."""
    return (
        F.when((prompt == "") | (answer == ""), "empty").when(~word_count(answer).between(1, 90), "answer_words").when(word_count(prompt) > 180, "prompt_words")
        .when(any_of(F.lower(answer), DIRECT_PHRASES), "phrase").when(non_english(prompt) | non_english(answer), "non_english").when(code_heavy(prompt) | code_heavy(answer), "code")
    )
