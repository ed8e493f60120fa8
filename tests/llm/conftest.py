import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n_tokens string, ids string, n_lines string, name string, gone string, position string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


@pytest.fixture(scope="session")
def odd_rows(spark, folder):
    """Test documents with odd ones among them: (doc_id, text)."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    random.seed(3)
    base = [f"word{random.randrange(400)}" for _ in range(120)]
    near = list(base)
    near[40] = "other"
    long = " ".join(f"t{random.randrange(3000)}" for _ in range(60_000))
    return rows + [
        (900_001, None),
        (900_002, ""),
        (900_003, " \t\n\x0b\r "),
        (900_004, " ".join(base)),
        (900_005, " ".join(near)),
        (900_006, " ".join(base)),
        (900_007, long),
        (900_008, "one two"),
        (900_009, "ONE  TWO"),
        (900_010, "x" * 50_000),
        (900_011, "same same same same same same same same same same same same same same same same"),
        (900_012, "Zwölf Boxkämpfer 日本語テキスト \U0001f600 ñandú\x85 end "),
        (900_012, "Zwölf Boxkämpfer 日本語テキスト \U0001f600 ñandú\x85 end "),
        (None, "a text without an id, that has some words of its own to be read here"),
        (900_013, "A shared line of some length\n\tA SHARED LINE of some length \nown"),
        (900_014, "A shared line of some length\nown too"),
        (900_015, "a shared line of some length"),
    ]


def frame(spark, rows):
    data = [(i, t, "en", "src0", len(t or ""), 0.5, "k", "t", "i", "l", "n", "g", "p") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd documents, with columns named as results are."""
    return frame(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
