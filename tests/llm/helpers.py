"""Made-up documents."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n_words string, bin int, _row string, blob int, score string, slot int, size long, node string"


def frame(spark, rows):
    """documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "x", 2, "r", 3, "s", 4, 5, "n") for i, t, s in rows], SCHEMA)
