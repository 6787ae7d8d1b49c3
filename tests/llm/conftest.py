import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("the of and rend thing onere atble shou ing edre lythe wh".split()) + rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): copies, near copies, shared passages, personal data, and every odd case."""
    rng = random.Random(11)
    passage = " ".join(words(rng, 60))
    base = [" ".join(words(rng, rng.choice([12, 30, 90, 300]))) for _ in range(25)]
    rows = list(enumerate(base))
    for i, text in enumerate(base[:8]):
        w = text.split()
        w[len(w) // 2] = "changed"
        rows += [(100 + i, text), (200 + i, " ".join(w)), (300 + i, text.upper() + "\n")]
    rows += [(400 + i, " ".join(words(rng, 20)) + "\n" + passage + ".\n" + " ".join(words(rng, 15))) for i in range(4)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "one two"), (505, "one two"), (506, "x" * 3000), (507, "tie tie tie " * 400)]
    rows += [(508, "mail a.b@x.org call +1 (499) 555-6503 now ip 10.0.0.256 1.2.3.4.5 card 4111 1111 1111 1111 é😀 c@d.e")] * 2
    rows += [(None, "no id at all here"), (None, None)]
    rows += [(600, "# * $ line\nsame line here\nsame line here\nsame line here\n" * 6), (601, "A B C D E F G H I J K L"), (602, "\0 odd \x01 bytes �")]
    rows += [(700, " ".join(words(rng, 20000)))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    extra = "items spans n_words keys set_id class score value key _id _text _key shard slot ids target n bucket".split()
    return docs.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
