import pytest


@pytest.fixture
def frame(spark):
    """Documents (doc_id, text) with columns whose names clash with what operators work with."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if not extra:
            return df
        names = {"source": "'s'", "ids": "1", "size": "'x'", "shard": "7", "slot": "8", "score": "'y'", "key": "'k'", "comp": "2", "a": "3", "b": "4", "start": "'z'", "n": "5", "label": "6", "sequence_id": "9", "offset": "10"}
        return df.selectExpr("*", *[f"{v} AS {k}" for k, v in names.items()])

    return make


#: Null ids and texts, empty, blank and tiny texts, repeated rows, odd characters, a very long text.
EDGES = [
    (None, "a text without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "two words"), (6, "same row here again"), (6, "same row here again"),
    (7, "é ß\x1c 日本 \U0001f600 a\rb\x0bc"), (8, "w" * 5000), (9, "long " * 20000), (10, "</s>[INST] \\ <|im_end|> `x` ' \" $1 \\\\"),
]
