import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were".split()


def prose(seed: int, n: int) -> str:
    """Words drawn by a fixed generator."""
    import numpy as np

    rng = np.random.default_rng(seed)
    syllables = ["ka", "lo", "mi", "ren", "tu", "ves", "po", "da"]
    return " ".join(WORDS[i % len(WORDS)] if i % 3 else "".join(syllables[j] for j in rng.integers(0, 8, 3)) for i in rng.integers(0, 3000, n))


@pytest.fixture
def messy(spark):
    """Documents with nulls in each column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = prose(1, 20_000)
    rows = [
        (1, prose(2, 300), "en", "a", 5), (2, prose(2, 300), "en", "a", 5), (3, None, "en", "b", None), (4, "", None, None, 0), (5, "   \n\t ", "de", "b", 3),
        (6, long, "fr", None, 1), (7, prose(3, 40) + "\n" + prose(4, 60), "en", "a", 2), (7, prose(3, 40) + "\n" + prose(4, 60), "en", "a", 2), (None, prose(5, 50), "es", "c", 2),
        (9, "x", None, "c", 1), (10, prose(2, 150) + " changed " + prose(6, 149), "en", "b", 1), (11, "Ärger über Öl 　mit Maß 123", "de", "c", 1), (12, "y" * 70_000, "en", "c", 1),
        (13, prose(7, 34), "en", "a", 1), (14, prose(8, 35), "en", "a", 1), (15, prose(8, 35), "en", "b", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    # fmt: off
    clashing = ("size", "tie", "score_", "node", "n", "words", "key", "part", "label", "target", "host", "lines", "range", "of", "component", "h", "rank", "start", "piece", "held_out", "lang_pred", "score", "taken", "fp0", "component_id", "n_lines", "n_removed", "sequence_id", "__lang", "__score", "__host", "__lines", "__dropped", "__twice", "__mix_doc", "__mix_tie", "__mix_size", "dropped", "twice", "of_key", "whole_row")
    # fmt: on
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clashing)])


@pytest.fixture
def empty(messy):
    """The same columns without rows."""
    return messy.where("false")
