"""Work that repeats is done once: words of texts in a batch, questions of a batch."""

import numpy as np
import pandas as pd

from sparkloft.operators import language_profiles as lp
from sparkloft.plans import compilers, queries_cases


def test_words_seen_before_give_the_same_probabilities():
    profiles = lp.Profiles(("a", "b"), {"_th": np.log([0.3, 0.1]), "the": np.log([0.2, 0.05]), "he_": np.log([0.1, 0.1]), "de_": np.log([0.01, 0.4])}, np.log([0.001, 0.002]))
    known = lp.KnownWords(profiles)
    for text in ("the the de", "de", "The xq", "xq", "", None, "the " * 50 + "de", " ".join(f"w{i}x" for i in "abcdefghij" * 20)):
        score, found = np.zeros(2), False
        for gram, n in lp.grams(text).items():
            score, found = score + n * profiles.shares.get(gram, profiles.rest), found or gram in profiles.shares
        e = np.exp(score - score.max())
        got = profiles.posterior(text, [0, 1], known)
        assert (got is None) == (not found) and (got is None or np.allclose(got, e / e.sum()))


def test_a_question_asked_again_is_routed_once(monkeypatch):
    asked = []
    real = compilers.intents
    monkeypatch.setattr(compilers, "intents", lambda q: asked.append(q) or real(q))
    questions = pd.Series(["which week had the highest error", "tell me a story", None] * 50)
    out = queries_cases._modes.func(questions.where(questions.notna(), "what depends on x"))
    assert len(asked) == 3 and len(out) == 150 and list(out[0]) == list(real("which week had the highest error"))
