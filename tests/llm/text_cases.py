"""Texts and rows that every operator must take."""

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", " \t\n", "one", "one two", "same line of words\n" * 40, "same line of words\n" * 40,
    "x" * 70_000, "word " * 9_000, "été  wide space \x1c sep 日本 \U0001f600 end", "a\r\nb\x0bc\x0cd",
    "The Same Words In Upper Case and some more words follow here now ok", "the same words in upper case and some more words follow here now ok",
]


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    extra = "n_words int, kept string, fp int, anchor string, starts int, _text string, component_id int, n_bytes int"
    return spark.createDataFrame(
        [(d, t, "en", "s", len(t) if t else 0, 1, "x", 2, "y", 3, "z", 4, 5) for d, t in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {extra}",
    )
