import random
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; they must not get in the way.
CLASHES = ("shard", "slot", "size", "label", "fp", "key", "row", "rid", "spans", "score", "host", "lang_pred", "start", "v", "n", "component_id", "taken", "src", "row_index", "digest")


def make_rows():
    rng = random.Random(5)
    words = {"en": "the of and to in that it was for on are with as".split(), "de": "der die und das nicht von sie ist des sich mit dem".split(), "fr": "les des est dans qui pour pas sur avec plus que une".split()}
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        tail = [rng.choice(words[lang]) + rng.choice("abcdefghij") * rng.randint(0, 1) for _ in range(rng.randint(20, 160))]
        rows.append((i, " ".join(tail) + ".", lang, f"s{i % 4}", 0))
    base = rows[0][1]
    rows += [(300 + i, base, "en", "hot", 0) for i in range(90)]  # a third are copies
    rows += [(400 + i, base + f" extra{i}", "en", "hot", 0) for i in range(5)]
    rows += [
        (500, None, None, None, None), (501, "", "en", "s1", 0), (502, "   \n\t", "de", "s1", 0), (503, "é", "fr", "s2", 1), (504, "12 34", None, "s2", 0), (505, "one two", "en", "s3", 0),
        (506, "word " * 30_000, "en", "s3", 0), (507, "x" * 100_000, "en", "s0", 0), (508, "a\x00b <|endoftext|> it's\r\n\x0b end", "en", "s0", 0),
        (None, "no id here at all, none", "en", "s0", 0), (None, "no id here at all, none", "en", "s0", 0), (7, rows[7][1], "de", "s3", 0), (7, rows[7][1], "de", "s3", 0), (8, "another text for eight", None, None, 0),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(data: bytes) -> int:
    return zlib.crc32(data)
