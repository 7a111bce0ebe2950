import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def made_up(n: int = 160, seed: int = 3) -> list[tuple]:
    """Documents with copies, near copies, shared passages, null and empty texts, a very long text, repeated rows and null columns."""
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(4000)] + ["été", "straße", "I", "a"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    passage, rows = text(70), []
    for i in range(n):
        kind = i % 8
        if kind == 1 and rows:
            body = rng.choice(rows)[1]
        elif kind == 2 and rows:
            parts = (rng.choice(rows)[1] or "x").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            body = " ".join(parts)
        elif kind in (3, 4):
            body = f"{text(rng.randint(0, 60))} {passage}\n{text(rng.randint(0, 60))}"
        elif kind == 5:
            body = rng.choice([None, "", " \n\t", "one", "A b", "#$% | < >", text(3)])
        else:
            body = text(rng.randint(1, 200)).replace(" w1", rng.choice(["\n", "  ", "\r\n", "\t"]) + "W1")
        rows.append((i, body, rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b", None]), None if body is None else len(body)))
    rows.append((n, text(9000), "en", "hot", 1))
    rows.append((n + 1, "same " * 3000, "en", "b", 1))
    rows.append(rows[0])
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_up()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 5), int(i % 9 == 0)) for i in range(160)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)
