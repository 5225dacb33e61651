"""Small document tables with the awkward cases every operator must take."""

EDGE_TEXTS = [None, "", " ", "a", "The quick  brown fox\n\n jumps over <|endoftext|> it  ", "x" * 3000, "é　日本 ẞ\x1cz don't", "same text here", "same text here", "tail \n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, shard int, bucket int"


def edge_docs(spark, texts=EDGE_TEXTS, repeat_id=True):
    rows = [(i, t, None, "s", None, 1, 2, 3) for i, t in enumerate(texts)]
    if repeat_id:
        rows += [(3, "a", "en", None, 1, 1, 2, 3), (3, "a", "en", None, 1, 1, 2, 3), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
