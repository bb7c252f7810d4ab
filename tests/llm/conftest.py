import os

import pytest

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")

#: Null ids, texts and sources, empty and blank texts, a very long text, repeated rows, ties,
#: and columns whose names the operators use inside.
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
EDGE = [
    (1, "a b c d e f g h", "en", "s1"),
    (1, "a b c d e f g h", "en", "s1"),
    (2, " a  b c\td e f g h", "en", "s2"),
    (3, "", "en", None),
    (4, None, None, None),
    (5, " \n ", "de", "s1"),
    (6, LONG, "en", "s1"),
    (7, LONG + " tail", "en", "s2"),
    (8, "A B C D E F G H", "en", "s3"),
    (None, "a b c d e f g h", "en", "s3"),
    (None, None, None, "s1"),
    (9, "one two", "en", "s2"),
    (10, "ONE two", "en", "s2"),
    (11, "é ß 中文   x", "fr", "s2"),
    (12, "x" * 5000, "fr", "s2"),
]


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    clash = ("id", "key", "n", "size", "kept", "_id", "_text", "taken", "score", "bucket")
    for name in clash:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
