"""Odd documents, and plain versions of what the operators do."""

import re

CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, node long, key string, "
    "label int, row string, score double, spans string, words string, n int, value binary"
)


def documents(spark, rows, schema=CLASHING):
    """Rows of (doc_id, text) with further columns whose names the operators use inside."""
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in the wood today"
ODD = [
    (1, PLAIN),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "Ünïcödé ΑΣ 漢字 😀 it's WE'LL 12345 <|endoftext|> x"),
    (6, PLAIN),  # a copy
    (7, PLAIN.upper()),
    (1, PLAIN),  # a repeated row
    (None, PLAIN),
    (8, "one"),
    (9, "a" * 6000),
    (10, "\x00 \x1c\x85  ok"),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
