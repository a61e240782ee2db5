"""Small tables and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # Names that the operators use inside must not meet columns of the table.
    return df.selectExpr("doc_id", "text", "'x' as h", "1 as n", "2 as pos", "3 as n_words", "'y' as lines", "'z' as `_lost`", "'en' as lang") if extra else df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def edited(rng: random.Random, words, times, vocabulary):
    words = list(words)
    for _ in range(times):
        at, kind = rng.randrange(len(words)) if words else 0, rng.random()
        if kind < 0.6 and words:
            words[at] += rng.choice("xyz")
        elif kind < 0.8 and len(words) > 3:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words
