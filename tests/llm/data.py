"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, node int, key string, removed int, rank int, taken int, target string, label int, ids string"


def text(dice: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{dice.randrange(vocabulary)}" for _ in range(n))


def documents() -> list[tuple]:
    dice = random.Random(8)
    base = text(dice, 120)
    words = base.split()
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(words))
    far = " ".join(w if i % 9 else "other" for i, w in enumerate(words))
    passage = "The " + text(dice, 58) + "."
    texts = [
        None, "", " \t\n", "one", "ONE", "one two three", base, base, base.upper(), near, far, near + " tail of words",
        text(dice, 300), text(dice, 40) + " " + passage + " " + text(dice, 30), "Start of it. " + passage + " and then " + text(dice, 25),
        passage, "x " * 500, "é à ü ß 中文 あ 😀 " * 5, "line one here\n" * 30, text(dice, 30_000, 3000), "#*$%&|<>" * 20, "▁ ▁▁ a  b ", "a\x0bb\x0cc\rd\te\nf",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(6, texts[6]), (6, texts[6]), (12, "another text of the same id " + text(dice, 30)), (None, base), (None, None), (None, "only here " + text(dice, 30))]
    sources = ["b", "a", None, "z", "ä"]
    return [(i, t, "en" if k % 3 else None, sources[k % 5], 1, "x", "y", 1, "k", 2, 3, 4, "t", 5, "i") for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def labels(spark, rows=None):
    if rows is None:
        rows = [(i, int(i % 5 != 0), 0, "x") for i in range(40)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (4, 0, 0, "x"), (4, 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
