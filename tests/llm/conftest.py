import random

import pytest

CLASH = "id long, h string, digest string, words int, kept int, fp string, k int, u int, piece string, part string, n_words string, __x int"


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(10, base[0]), (11, base[0].upper()), (12, base[1] + " zz"), (12, base[1] + " zz"), (13, None), (14, ""), (15, " \t\n"), (None, "null id"), (None, "null id"), (None, base[2])]
    texts += [(16, " ".join(word() for _ in range(20_000))), (17, "x" * 50_000), (18, "a"), (19, "a b c"), (20, "l1\nl2\nl3\nl1\nl2\nl3"), (21, "<|endoftext|> </s> ▁ é  x ")]
    rows = [(i, t, None, None, None, *([None] * 12)) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(5)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.where("false")


@pytest.fixture(scope="session")
def pairs(hard):
    return [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
