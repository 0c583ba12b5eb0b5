"""Rows with nulls, empty and long texts, ties and repeats, and extra columns whose names operators use inside."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, bucket int, score double, n int, node long, toxicity double, language string"
LONG = "alpha beta gamma delta epsilon " * 4000 + "x" * 30_000


def rows():
    texts = [
        (1, "One two three four five six seven eight.", "en", "a"),
        (2, "One two three four five six seven eight.", "en", "b"),
        (3, "", "en", "a"),
        (4, None, "en", None),
        (5, " \t\n ", None, "a"),
        (6, LONG, "en", "b"),
        (7, "12 34 ... !!", "en", ""),
        (8, "Ärger über größere Straßen und Öl", "de", "c"),
        (8, "Ärger über größere Straßen und Öl", "de", "c"),
        (None, "no id here at all", "en", "c"),
        (9, "ein zwei drei vier fünf sechs sieben \U0001f600", "de", None),
        (10, "word", "en", "a"),
    ]
    return [(i, t, l, s, len(t or ""), "k", 1, 2, 0.5, 3, 4, 0.1, "x") for i, t, l, s in texts]


def edge_documents(spark):
    return spark.createDataFrame(rows(), COLUMNS)


def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
