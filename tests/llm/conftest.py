import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(d, t, None, "s", len(t) if t is not None else None) for d, t in rows], SCHEMA)
    return make


@pytest.fixture
def messy_rows():
    """Nulls, empty texts, blanks, repeated rows, copies, ties, a very long text and line."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, footer = text(30), "A footer line that many documents hold"
    rows = [(1, None), (2, ""), (3, " \t\n \x0b"), (4, "one"), (5, "two words"), (6, "é" * 60), (7, "x" * 400)]
    for i in range(10, 30):
        rows.append((i, f"{text(rng.randint(5, 60))}\n{shared if i % 3 else text(4)}\n  {footer.upper() if i % 2 else footer}\t\n{text(9)}"))
    rows += [(40, rows[10][1]), (41, rows[10][1]), (42, rows[12][1] + " end"), (43, text(2000)), (44, rows[-1][1] + " more")]
    rows += [(45, "token = abcdef123456 " + "0123456789abcdef" * 3), (46, "AKIA" + "B" * 16 + ' PASSWORD: "hunter22"')]
    rows += [(47, footer), (48, footer + "\n" + footer), (50, "a b c a b c a b c d")]
    return rows
