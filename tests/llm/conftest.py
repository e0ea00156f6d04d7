import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, fingerprint int, ids string, _text string, passes string, held_out string"


def make(spark, rows):
    """A documents frame of (doc_id, text, lang, source), with further columns whose names clash with results."""
    return spark.createDataFrame([(*r, 0, "x", 1, 2, "y", "z", "p", "h") for r in rows], SCHEMA)


def prose(seed: int, words: int, vocabulary: str = "the of and lorem ipsum dolor sit amet consectetur adipiscing elit sed tempor magna aliqua") -> str:
    r = random.Random(seed)
    v = vocabulary.split()
    return " ".join(r.choice(v) + ("." if r.random() < 0.1 else "") for _ in range(words))


ODD = [None, "", " \t\n\x0b\f\r ", "a", "A b", "é ü   x", "same same same same same", "x" * 3000, "<|endoftext|> a  b\n\n c", "#$%& <>|", "\x1c\x1d a\x85b", "- a\n- a\n\n- b...", "😀 👩‍👩‍👧 ١٢٣"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, a repeated id and two null ids."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}") for i, t in enumerate(ODD)]
    rows += [(3, "a", "en", "s1"), (3, "other text of the same id", "de", "s0"), (None, "no id here", "en", None), (None, None, None, None), (100, prose(1, 30_000), "en", "s1"), (101, prose(1, 30_000), "en", "s1")]
    return make(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter(F.lit(False))
