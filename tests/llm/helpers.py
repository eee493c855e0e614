import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows):
    """documents with a clashing extra column."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], schema)


def words(text):
    return WORD.findall(text or "")
