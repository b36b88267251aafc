import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag string, tag string, _own int, bucket string, size int, position string, _id long, node string, score string"
WORDS = "the of to and in on a is that for was with as by at from red blue sword shield house river stone light cloud winter summer garden table letter paper music".split()


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", "", "s", "ing", ","]) + ("." if k % 9 == 8 else ""))
    return " ".join(out) + "."


def rows(seed=0):
    """Plain rows, and nulls, empty and long texts, copies, repeated rows and ids, and ties."""
    rng = random.Random(seed)
    out = []
    for i in range(60):
        out.append((i, prose(rng, rng.choice([3, 8, 60, 150, 400])), "en", f"s{i % 4}" if i % 3 else "hot", 5))
    base = prose(rng, 200)
    for i in range(60, 66):  # near copies: one word of two hundred changed
        words = base.split()
        words[10 + 7 * (i - 60)] = "changed"
        out.append((i, " ".join(words), "en", "hot", 5))
    out += [(i, out[4][1], "en", "hot", 5) for i in range(66, 70)]  # copies
    out += [out[4], out[4]]  # rows alike
    out += [(7, "another text with the same id as an earlier row", None, None, None)]
    out += [(70, None, None, None, None), (71, "", "", "", 0), (72, " \n\t ", None, None, None), (None, None, None, None, None), (None, out[8][1], None, "s1", None), (None, "only words", None, None, None)]
    out += [(73, "long " * 30_000, "en", "s2", 1), (74, "x" * 100_000, "en", "s2", 1), (75, "tie tie", "en", "s3", 1), (76, "tie tie", "en", "s3", 1)]
    return [(*r, "t", "t", 1, "b", 2, "p", 3, "n", "s") for r in out]


@pytest.fixture(scope="session")
def nasty_rows():
    return rows()


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):
    return spark.createDataFrame(nasty_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
