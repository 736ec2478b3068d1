import pytest

#: Rows that every operator on documents must take: nulls in any column, empty and long texts, ties, repeated rows,
#: and extra columns whose names operators use themselves.
LONG = "lorem ipsum " * 40_000


@pytest.fixture(scope="session")
def hard(spark):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en"), (2, "the QUICK brown fox jumps over the lazy dog.", "en"), (2, "the QUICK brown fox jumps over the lazy dog.", "en"), (3, None, None), (4, "", "en"),
        (None, "a text without an id", "en"), (None, None, None), (5, LONG, "la"), (6, "  spaced  out \n\n text\t<|endoftext|> ", "en"), (7, "naïve — “quoted” 漢字 😀   end", "xx"), (8, "one", "en"), (9, "é" * 5000, "fr"), (5, "other text of five", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = {c: "1" for c in ("keep_id", "digest", "row", "key", "n_tokens", "ids", "score", "found", "id", "bucket", "component")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()}).cache()
