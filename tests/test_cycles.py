"""Shuffled cycles of templates against a plain loop, and counts taken while rows are written."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainyard.operators import templates
from grainyard.sources import files

WEIGHTS = {"a": 3, "b": 1, "c": 2}
FORMS = [("a", 0, "Who is {x}?", "It is {x}."), ("a", 1, "Tell {x}", "user: {x}"), ("b", 0, "Say {x}", "{x}"), ("c", 0, "Hi  {x}", "Hello {x}.")]
SLOTS = {"a": [f"A{i}" for i in range(40)], "b": ["B", "b", "B2"], "c": [f"C{i}" for i in range(11)]}


def numbers(n, block, seed):
    places, seen, out = [c for c, k in WEIGHTS.items() for _ in range(k)], Counter(), []
    for i in range(n):
        order = sorted(range(len(places)), key=lambda s: hashlib.sha1(f"{seed}:{i // block}:{s}".encode()).hexdigest())
        c = places[order[i % len(places)]]
        out.append((i, c, seen[c]))
        seen[c] += 1
    return out


def tables(spark):
    forms = spark.createDataFrame(FORMS, "category string, form bigint, prompt string, answer string")
    slots = [(c, i, {"x": v}) for c, values in SLOTS.items() for i, v in enumerate(values)]
    return forms, spark.createDataFrame(slots, "category string, slot bigint, values map<string,string>")


def brute(count, block, seed):
    """Numbers of the kept examples, and (kept, rejected, repeated)."""
    forms, seen, kept, told = {c: [f[2:] for f in FORMS if f[0] == c] for c in WEIGHTS}, set(), [], Counter()
    for i, c, v in numbers(5000, block, seed):
        value = SLOTS[c][v % len(SLOTS[c])]
        q, a = (t.replace("{x}", value) for t in forms[c][v // len(SLOTS[c]) % len(forms[c])])
        key = " ".join(f"{q} {a}".lower().split())
        if "user:" in a:
            told["rejected"] += 1
        elif key in seen:
            told["repeated"] += 1
        else:
            seen.add(key)
            kept.append(i)
            if len(kept) == count:
                break
    return kept, (len(kept), told["rejected"], told["repeated"])


@pytest.mark.parametrize(("n", "block", "seed"), [(0, 97, "0"), (1, 97, "0"), (500, 97, "7"), (61, 4, "x"), (97, 97, "0")])
def test_shuffled_numbers(spark, n, block, seed):
    assert sorted(map(tuple, templates.shuffled(spark, n, WEIGHTS, block, seed).collect())) == numbers(n, block, seed)


@pytest.mark.parametrize(("count", "block", "seed"), [(1, 97, "0"), (20, 97, "1"), (53, 10, "s")])  # 53 is all that there are
def test_until_count(spark, count, block, seed):
    found = templates.until_count(spark, count, WEIGHTS, *tables(spark), block, seed)
    kept, told = brute(count, block, seed)
    ids = templates.template_examples(found, "g", "r").select(F.substring_index("id", "_", -1).cast("int")).collect()
    assert sorted(r[0] for r in ids) == kept
    assert tuple(templates.counts(found).where("category IS NULL").select("kept", "rejected", "repeated").first()) == told


def test_until_count_errors(spark):
    assert templates.until_count(spark, 0, WEIGHTS, *tables(spark)).count() == 0
    with pytest.raises(ValueError, match="300 attempts give 53 examples"):
        templates.until_count(spark, 54, WEIGHTS, *tables(spark), most=300)


def test_counts_with_the_write(spark, tmp_path):
    rows = [("one text", None, "training", 1), ("two texts ", None, "testing", 2), ("bad", "short", "training", 3), (None, None, "training", 4), ("odd", "else", None, 5), ("one text", None, "more", 6)]
    docs = spark.createDataFrame(rows, "text string, reason string, split string, seen int")
    want = {"seen": 6, "kept": 3, "characters": 8 + 10 + 8 + 6, "rejected_short": 1, "rejected_url": 0, "training_documents": 1, "validation_documents": 0, "testing_documents": 1}
    assert files.write_pretrain_counted(docs, str(tmp_path / "a"), ["short", "url"]) == want
    assert sorted(map(tuple, files.split_sizes(spark, str(tmp_path / "a")).select("split", "documents").collect())) == [("more", 1), ("testing", 1), ("training", 1)]
    assert files.write_pretrain_counted(docs.limit(0), str(tmp_path / "b"), ["short", "url"]) == dict.fromkeys(want, 0)
