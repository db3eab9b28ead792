"""Rows with every oddity that the operators define a result for."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, row string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(start: int, n: int) -> str:
    return " ".join(WORDS[(start * 7 + i * i + i // 3) % len(WORDS)] + str((start * 13 + i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing columns."""
    texts = [(i, f"{sentence(i, 30)}.\n{sentence(i + 100, 12)}\n\nThe same closing line in every text.") for i in range(12)]
    texts += [(20, None), (21, ""), (22, " \n\t "), (None, "no id here at all, only words"), (None, None), (23, "word"), (24, "WORD")]
    texts += [(3, texts[3][1]), (3, texts[3][1]), (30, texts[3][1]), (31, texts[4][1].replace("alpha", "alphas", 1)), (5, "another text under a used id")]
    texts += [(40, "é漢😀 <|endoftext|> 'll it's x  y\t\tz\r\n" * 3), (41, "x" * 3000), (42, " ".join(["again"] * 4000)), (43, sentence(7, 2500))]
    return [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", len(t or ""), "k", n, None) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
