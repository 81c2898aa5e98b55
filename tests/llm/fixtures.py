"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 66, "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 66, None),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 66, None),
    (3, "", "en", "b", 0, "y"),
    (4, None, None, None, None, None),
    (None, "Ein kurzer Satz über Äpfel, Öl und süße Früchte im Herbst.\nEin kurzer Satz.\nEin kurzer Satz.", "de", "b", None, "z"),
    (5, "word " * 30_000, "en", "a", 150_000, "x"),
    (6, "it's a   test\tof <|endoftext|> marks…, 3.14 and 'll quotes'   end don't A'B", "en", None, 3, "x"),
    (7, "   \n\t ", None, "c", 6, "x"),
    (8, "Δοκιμή κειμένου ΣΟΦΟΣ ΣΑΣ, ſ İ ﬁ é \U0001f600\U0001f600 12 345", "el", "c", 40, "x"),
    (9, "one", "en", "a", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def write(spark, path, rows=ROWS, schema=SCHEMA):
    """The rows as a documents table in a folder of their own."""
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)
