"""Awkward documents that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, _gone int"


def awkward(spark, more=()):
    long_text = "alpha beta gamma delta " * 6000
    texts = [
        (1, "The quick brown fox jumps over the lazy dog.", "en"), (2, "The quick brown fox jumps over the lazy dog.", "en"), (3, None, None),
        (4, "", "en"), (5, "   \n\t ", None), (6, long_text, "en"), (7, "x", "en"), (None, "no id at all here", "en"), (None, None, None),
        (9, "¿Qué? ÀÉ ▁ ﬁ Ⅷ\u0000 \U0001F600 tab\there", "es"), (9, "the same id, other text", "en"), (10, "same row", "en"), (10, "same row", "en"),
        (11, "12345 67890 ... !!!", "en"), (12, "a\n\nb\n\n\nc  d   e", "de"), (13, "é" * 500, "fr"), (14, "<|im_end|> ſecret: Kelvin", "en"), *more]
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 5, "c", 0) for i, t, g in texts], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
