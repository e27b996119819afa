"""Small frames with the awkward cases that every operator has to take."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, id string, target string"


def documents(spark, rows):
    """rows of (doc_id, text, lang, source); further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None, 7, 0.5, True, "x", None) for i, t, lang, s in rows], DOCUMENTS)


def prose(rng: random.Random, n: int, words: str = "the of and crate vendor buyer order cash term open late hand total week rate year stone river light") -> str:
    return " ".join(rng.choices(words.split(), k=n))


def awkward(spark, seed=1):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    rng = random.Random(seed)
    base = prose(rng, 300)
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n\x0b ", "en", "a"),
        (4, "one", "en", "a"),
        (5, base, "en", "b"),
        (5, base, "en", "b"),
        (6, base, "de", None),
        (7, prose(rng, 60_000), "en", "b"),
        (8, "ÀÉ 漢字 👍🏽 \x00 end.", "fr", "é"),
        (None, "text without an id", "en", "a"),
        (9, base + " tail", "en", "b"),
    ]
    return documents(spark, rows)
