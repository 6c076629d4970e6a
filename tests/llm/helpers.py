"""Small tables with every oddity, and texts to fill them."""

import random

WORDS = ["river", "stone", "garden", "window", "market", "silver", "winter", "letter", "bridge", "forest", "candle", "harbour", "mirror", "valley", "copper", "meadow"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"key": "'k'", "node": "1", "line": "'l'", "row": "2", "batch": "3", "rate": "0.5D", "copies": "7L", "n_words": "1L", "n_tokens": "2L", "token_ids": "'x'", "quality_score": "'q'", "p_clean": "'p'", "__key": "'a'", "__keep": "'b'", "__n": "'c'", "__u": "'d'", "__copy": "'e'", "__lang": "'f'", "word_length": "'g'"}


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(500)) for _ in range(n))


def table(spark, rows, clash=False):
    """rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] or ("en", "web")), None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASH.items()]) if clash else df


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows and repeated ids."""
    return [
        (1, prose(60, 1), "en", "web"),
        (1, prose(60, 1), "en", "web"),
        (1, prose(30, 2), "en", "web"),
        (2, None, "en", "web"),
        (3, "", None, "web"),
        (4, "  \n \n", "en", None),
        (None, prose(20, 3), "de", "web"),
        (None, None, None, None),
        (5, "\n".join(prose(40, 100 + i) for i in range(3000)), "en", "web"),
        (6, "x" * 200_000, "en", "web"),
        (7, "…—!?", "en", "web"),
        (8, "one", "en", "web"),
        (9, "two\ntwo\n\ntwo", "en", "web"),
        (10, "ünï cödé 日本語 \U0001f600 words", "fr", "web"),
    ]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
