import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, fp string, kept boolean, n_words int"


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows: nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß漢😀") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 250))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(150))
    texts = base + [base[3]] * 4 + [base[5] + " x", base[5] + " y z", "", None, " \n\t", "one", "Two Words", "a b c", "'s <|endoftext|> 12", "zz " * 400, passage + base[7], base[8] + passage, "m " + passage + " n", "\n".join(["line one two"] * 30)]
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t), "x", None, True, i) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[9], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
