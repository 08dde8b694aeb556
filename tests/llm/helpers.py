"""Small fixtures with nulls, empty and long texts, repeated rows and clashing column names."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{k}" for k in range(300)] + ["Été", "straße", "THE", "the", "Of", "of"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, line string, n long, node long, h long, word string, copies long, class string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=1):
    """Rows (doc_id, text, lang, source) with the cases that every operator must stand."""
    rng = random.Random(seed)
    passage, near = prose(rng, 60), [prose(rng, 1) for _ in range(120)]
    rows = [(k, prose(rng, rng.choice([1, 2, 5, 40, 90])), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for k in range(40)]
    rows += [(100 + k, f"{prose(rng, 10)} {passage}\n{prose(rng, 10)}", "en", "a") for k in range(4)]
    rows += [(110 + k, " ".join(w if i != 7 * k + 3 else "other" for i, w in enumerate(near)), "en", "a") for k in range(8)]
    rows += [(130 + k, "same text of a few words\nand a line that is long enough to count as one, surely", "fr", "b") for k in range(6)]
    rows += [(140, None, None, None), (141, "", "en", "a"), (142, " \t\n\x0b ", "en", "a"), (143, prose(rng, 5000), "en", "c"), (144, "   x  y   z ", "fr", "c"), (145, "12 34 !!", "en", "a"), (146, "un mot<|endoftext|> ici", "fr", "b"), (147, "the the " * 60, "en", "b")]
    rows += [(150, passage, "en", "a"), (150, passage, "en", "a"), (None, "a null id and a few words", "en", "a"), (None, "a null id and a few words", "en", None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 1, "x", 2, 3, 4, "y", 5, "z") for r in rows], SCHEMA).repartition(3)
