"""Rows and helpers shared by the tests."""

#: Names that the operators use inside; a table may have them too.
CLASHES = ("node", "sig", "row", "block", "run", "comp", "ids", "length", "word", "sentence", "score", "kept", "text_sha256",
           "_block", "_row", "_tie", "start", "label", "toxic", "quality", "held_out", "text_hash")
LONG = "many words of one very long text " * 4000 + "x" * 50_000 + " end 4111 1111 1111 1111."
EDGE = [
    (1, "One short text, nothing else."), (2, None), (3, ""), (4, LONG), (4, LONG), (5, "twice the same"), (6, "twice the same"),
    (7, "   \n\n \t "), (8, "mail a.b@c.example.org and 10.0.0.1\nnext"), (9, "日本語 \U0001f600 éè <|endoftext|> ▁x"),
    (None, "no id here"), (None, None), (8, "another text under the same id"), (10, "a"),
]


def local(df):
    return df.select("doc_id", "text").toPandas().astype({"doc_id": "int64"}).sort_values("doc_id")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
