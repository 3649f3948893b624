"""Documents that every operator has to bear."""


DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, sid long, spans string, label int, path string, taken string, epoch string"


def odd_documents(spark, *more):
    """Null and empty texts, blanks, a very long one, null columns, ties and repeated rows; and columns with clashing names."""
    words = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " \t\n ", "one", "a b", words, "same text here " * 30, "same text here " * 30, "é ß 漢字 😀 token = abcdefgh1"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None, 1, 2, "x", 3, "p") for i, t in enumerate(texts)]
    rows += [rows[6], (3, "other text of the same id", "de", "s", 5, 1, 2, "x", 3, "p"), (None, "no id", None, None, None, 1, 2, "x", 3, "p"), *more]
    return spark.createDataFrame([(*r, "t", "e") for r in rows], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


