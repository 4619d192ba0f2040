import pytest

from formloom.llm import queries as q

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
#: Nulls, empty and very long texts, ties and repeated rows.
EDGE = [
    (5, "a b c d e f g h i j", "en"), (5, "a b c d e f g h i j", "en"), (6, "a b c d e f g h i j", "en"), (7, None, "en"), (8, "", None), (9, "  \n\t ", "de"),
    (10, LONG, "de"), (11, LONG + " more", None), (12, "two words", "fr"), (13, "two words", "fr"), (14, "Two  WORDS", "fr"), (None, "no id here", "es"), (15, "é漢字🙂 ß", "es"), (None, None, None), (16, "a <|endoftext|>  <|startoftext|>b", "en"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with further columns whose names clash with inner ones."""
    rows = [(d, t, la, "s", 0, 1, 2, "v", 3.0, 4, "x") for d, t, la in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, v int, key string, score double, bucket int, _score string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (10, 0, 1), (12, 0, 1), (None, 1, 1), (13, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def run(spark):
    made = {}

    def get(name, sf=SF):
        if (name, sf) not in made:
            made[name, sf] = q.queries()[name](spark, sf).toPandas()
        return made[name, sf]

    return get
