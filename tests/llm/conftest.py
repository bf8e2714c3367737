import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _x int, _row string, row int, fp double, key string, kept boolean, _h int, size string, word int, segment int"


def prose(n, seed, words=400):
    r = random.Random(seed)
    made = ["".join(r.choice("abcdefghijkélmno") for _ in range(r.randint(1, 8))) for _ in range(words)]
    return " ".join(r.choice(made) for _ in range(n))


def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters."""
    long = prose(30_000, 5)
    base = prose(120, 1)
    texts = [
        (1, base), (2, base), (2, base), (3, base + " tail words here"), (4, ""), (5, None), (None, base), (None, None), (6, "   \n\t "), (7, "one"), (8, "two words"), (9, long),
        (10, "Ünï CÖDE 漢字 mixed Case nbsp \x1c sep " + prose(60, 2)), (11, prose(80, 3) + " " + base), (12, "a b c a b c a b c a b c a b c a b c " * 5), (13, "x" * 200_000), (14, prose(200, 4)), (15, prose(200, 4)), (-3, prose(70, 6)), (10**15, prose(90, 7)),
    ]
    return [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None, n, "clash", n, 0.5, "k", n % 2 == 0, 1, "size", 2, 3) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir(spark, odd, tmp_path_factory):
    """A folder with small tables, as queries read them."""
    root = str(tmp_path_factory.mktemp("sf"))
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{root}/documents.parquet")
    texts = [t for _, t, *_ in rows()]
    bench = [(1, " ".join(texts[0].split()[10:40])), (2, "two words"), (3, None), (4, ""), (None, " ".join(texts[16].split()[5:20])), (1, "one")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (12, 0, 0), (None, 1, 0), (14, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root
