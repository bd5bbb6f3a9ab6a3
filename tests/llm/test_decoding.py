"""Loss-weighted decoding of language codewords against plain Python."""

import math
import random

import numpy as np
import pytest

from vectide.llm import language


def decoded_by_hand(model, text):
    """Every codeword's loss summed bit by bit; the nearest language, its share, and whether the next one is close."""
    found = [int(g) for g in language.grams(text)]
    bits = model.codes.shape[1]
    margins = [sum(float(model.weights[g, b]) for g in found) / len(found) * 12.0 * min(1.0, len(found) / 24.0) for b in range(bits)]
    losses = [sum(math.log1p(math.exp(-row[b] * margins[b])) for b in range(bits)) for row in model.codes]
    ranked = sorted(range(len(losses)), key=lambda i: losses[i])
    lead = losses[ranked[1]] - losses[ranked[0]]
    share = 1 / sum(math.exp(losses[ranked[0]] - loss) for loss in losses)
    return model.languages[ranked[0]], share, lead


@pytest.mark.parametrize("n", [2, 4, 9])
def test_nearest_codeword(n):
    random.seed(n)
    codes = language.codewords(n)
    weights = np.random.default_rng(n).normal(0, 0.4, (language.BUCKETS, codes.shape[1])).astype(np.float32)
    model = language.Model([f"l{i}" for i in range(n)], codes, weights)
    seen = set()
    for size in (1, 3, 8, 40, 300):
        for _ in range(6):
            text = " ".join("".join(random.choices("abcdeéñ", k=random.randrange(1, 9))) for _ in range(size))
            name, score, ambiguous = model.predict(text)
            expected, share, lead = decoded_by_hand(model, text)
            assert score == pytest.approx(share, rel=1e-4)
            if abs(lead) > 1e-4:
                assert name == expected
            if abs(lead - language.LEAD) > 1e-3:
                assert ambiguous == (lead < language.LEAD)
            seen.add(name)
    assert len(seen) > 1


def test_texts_without_letters_have_no_language():
    codes = language.codewords(3)
    model = language.Model(["a", "b", "c"], codes, np.zeros((language.BUCKETS, codes.shape[1]), np.float32))
    for text in (None, "", " \n", "12 3 ..."):
        assert model.predict(text) == (language.UNKNOWN, 0.0, True)
    name, score, ambiguous = model.predict("letters")
    assert ambiguous and score == pytest.approx(1 / 3) and name in model.languages
