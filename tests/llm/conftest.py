import os

import pytest

SF = "/root/testdata/sf0.001"

# Every awkward row at once: NULLs, empty and blank texts, repeats, ties, a long text, clashing columns.
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "ONE two three four five six seven eight nine ten"),
    (2, "ONE two three four five six seven eight nine ten"),
    (3, "one two three four five six seven eight nine ten eleven"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (None, "one two three four five six seven eight nine ten"),
    (None, None),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "short"),
    (10, "one two\nthree four"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "x", i, 0, "kept", "clash", "row") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, hash string, keep_id long, score int, kept string, norm string, `row` string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
