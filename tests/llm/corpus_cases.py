"""Texts for the corpus operators' tests."""

from __future__ import annotations


def sentence(seed: int, n: int = 30) -> str:
    """n made-up words, drawn by the seed."""
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abdeghiklmnoprstu", k=rng.randint(2, 8))) for _ in range(n))


#: Texts that every operator must take: nulls, blanks, other scripts, repeats, long ones.
ODD = [None, "", " \t\n", "a", "A b.", "é́ ñ 中文 русский\x1c x", "it's <|endoftext|> don't", "x" * 5000, sentence(1, 3000), sentence(2), sentence(2), "İstanbul ×÷ ǅ", "1 22 333. a1b2  \n\n  c"]
