"""Small tables with awkward rows, and brute-force versions of text handling."""

from __future__ import annotations

import re

_WORD = re.compile(r"[a-z0-9ªµºÀ-῿⁀-\U0010ffff]+")


def split_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(text: str | None, n: int) -> set:
    w = split_words(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))

#: Awkward documents: null id, null, empty and word-less texts, repeats, one very long text, other letters.
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank yesterday"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank yesterday"),
    (3, None),
    (4, ""),
    (5, " \n\t ... !!"),
    (None, "a document without an id that is like no other one in this table"),
    (6, "one"),
    (7, "one"),
    (8, LONG),
    (9, LONG + " with another end"),
    (10, "Über den Wolken muß die Freiheit wohl grenzenlos sein, alle Ängste, alle Sorgen"),
    (11, "über den wolken muß die freiheit wohl grenzenlos sein alle ängste alle sorgen!"),
    (12, "entirely different words fill this lonely line of text and match nothing else"),
]


def documents(spark, data=None):
    """With columns whose names clash with those the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "z", "q", 0.5) for i, t in (DOCS if data is None else data)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label long, `row` string, `a.b` string, rate double").repartition(3)


def no_documents(spark):
    return documents(spark, []) if False else spark.createDataFrame([], documents(spark).schema)
