"""A small documents table of awkward rows, and an empty one, with extra columns whose names the operators use themselves."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, size int, score double, fp long, batch string"


def rows_of(texts, langs=None, sources=None, ids=None):
    out = []
    for k, t in enumerate(texts):
        i = ids[k] if ids else k
        out.append((i, t, langs[k] if langs else "en", sources[k] if sources else f"s{k % 3}", None if t is None else len(t), 7, "x", 1, 0.5, 3, "b"))
    return out


LONG = " ".join(f"word{k % 977} tail{k % 1013}" for k in range(30_000))
TEXTS = [None, "", " \t\n", "one", "one two", "one  two", "One Two", LONG, LONG + " end", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "\n\nx\n\ny\n", "é è ü ñ ß \U0001f600 z", "a b c d e f g h i j k l"]
IDS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None, 9]
SOURCES = ["b", None, "a", "b", "a", None, "b", "a", "c", "b", "b", "a", None, "b"]
LANGS = ["en", None, "de", "en", "de", "en", "fr", "en", "en", None, "en", "de", "fr", "en"]


def awkward(spark):
    return spark.createDataFrame(rows_of(TEXTS, LANGS, SOURCES, IDS), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
