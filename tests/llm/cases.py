"""Documents with awkward rows, shared by the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, k string, spans int"
WORDS = "the of and to in is was for on that by this with from at as it be are or an which you had have not one were all we when there can more if no out so said what up its about into than them only other time".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    """A row of documents with extra columns that clash with names of results."""
    return (doc_id, text, lang, source, len(text or ""), 0.5, "x", "y", 1)


def awkward(spark):
    """Null, empty, blank, junk, repeated and long texts, a null id, a null source and repeated rows."""
    rng = random.Random(5)
    rows = [row(1, None), row(2, ""), row(3, "  \n "), row(4, "%%% $$$"), row(5, "%%% $$$"), row(6, "one"), row(7, "One!"), row(None, words(rng, 80)), row(8, words(rng, 90), None, None)]
    long = words(rng, 9000)
    rows += [row(9, long), row(10, long), row(11, words(rng, 70)), row(11, words(rng, 40))]
    rows += [row(12, "x é 漢字 " + words(rng, 60))] * 2
    rows += [row(13, "The " * 400), row(14, "0" * 700)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
