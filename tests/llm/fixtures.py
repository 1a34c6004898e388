"""Small tables with the cases every operator must define: nulls, empty texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, stems: str = "en") -> str:
    draw = random.Random(f"{seed}-{stems}")
    parts = {"en": ["th", "er", "ing", "and", "wh", "ou", "st"], "de": ["sch", "ung", "ei", "zu", "ge", "keit", "pf"]}[stems]
    words = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def documents(spark, extra: bool = True):
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join(x if i % 7 else "other" for i, x in enumerate(words))
    passage = prose(2, 70)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, near, "en", "b", 1),
        (4, far, "en", None, 1),
        (5, None, None, "b", None),
        (6, "", "en", "c", 0),
        (7, " \t\n", "de", "c", 3),
        (8, "one two", "en", "a", 7),
        (9, "ONE two", "en", "b", 7),
        (10, prose(3, 50) + "\n" + passage, "en", "c", 1),
        (11, passage + " " + prose(4, 40), "en", "a", 1),
        (12, prose(5, 90, "de"), "de", "b", 1),
        (13, prose(6, 80, "de") + "\x0b\x0c\r" + "é ü 漢字 1234 !!", "de", None, 1),
        (14, " ".join(["same"] * 90), "en", "a", 1),
        (15, prose(7, 6000), "en", "a", 1),
        (15, prose(7, 6000), "en", "a", 1),
        (None, prose(8, 60), "en", "a", 1),
        (17, "### $$$ %%% " * 40, None, "c", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        names = ("class", "gram", "queue", "print", "score", "lang_pred", "bucket", "root", "window", "size", "copies")
        for name in names:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
    return df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
