"""Small tables with awkward rows, and plain Python versions of what the operators define."""

import random

WORDS = "the of and to in is it was for on that by this with as at be or from are not have".split()

#: Null and empty texts, white space alone, repeated rows, equal texts of different white space, odd characters.
AWKWARD = [
    (1, "alpha  beta\tgamma"),
    (2, "alpha beta gamma"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "alpha beta gamma"),
    (7, "Ünï çødé 😀 \x1c text here end \x85 \x00 nul"),
    (8, "it's we'll   12345   !!!\r\n\n  end  "),
    (8, "it's we'll   12345   !!!\r\n\n  end  "),
    (None, "no id"),
    (None, "no id"),
    (9, "word " * 5000),
    (10, None),
]


def frame(spark, rows, extra=True):
    """documents-like rows, with columns whose names might clash with an operator's own."""
    schema = "doc_id long, text string" + (", n long, lanes string, norm string, spans string, place int, h string" if extra else "")
    return spark.createDataFrame([(*r, 1, "x", None, "y", 2, "z") if extra else r for r in rows], schema)


def corpus(n, seed=0, words=60):
    rng = random.Random(seed)
    return [(i, "\n".join(" ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randint(1, words))) for _ in range(rng.randint(1, 3)))) for i in range(n)]
