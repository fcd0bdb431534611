import random

import pytest

LETTERS = ["th", "an", "er", "ou", "é", "re", "ing", "st"]


def sentence(rng, n):
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """doc_id, text, lang, source, n_chars, with nulls, empties, copies, repeated rows, a long text and clashing names to add."""
    rng = random.Random(11)
    shared = sentence(rng, 60)
    base = sentence(rng, 80).split(" ")
    texts = [None, "", " \n\t", "a", "a b", "12 ,", sentence(rng, 4000), shared, shared, sentence(rng, 30) + "\n" + shared, "x " + shared + " " + sentence(rng, 20)]
    for k in range(6):
        near = list(base)
        near[k * 7] = "changed"
        texts.append(" ".join(near))
    texts += ["ab" * 400, "same line here\nsame line here\nsame line here\n" * 20]
    texts += [sentence(rng, rng.randint(1, 120)) for _ in range(12)]
    out = [(i, t, ["en", "fr", None][i % 3], f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[10], out[10], (None, "text without an id " + shared, "en", None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark, docs, tmp_path_factory):
    """A folder like the driver's, of these documents."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    shared = docs.where("doc_id = 7").first().text
    item = " ".join(shared.split(" ")[5:40])
    bench = [("b1", item), ("b2", item.upper()), ("b3", "a"), ("b4", None), ("b5", ""), (None, item), ("b6", "not there at all")]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty_sf(spark, empty, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    empty.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d
