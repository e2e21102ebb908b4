"""Small document tables for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source="s", lang="en"):
    rows = [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
