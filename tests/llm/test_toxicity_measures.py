"""Measures of a text against plain counts, and on long runs."""

import random
import re
import time

from twintrail.llm import toxicity

PLAIN = re.compile(r"\w[@$!*#0-9.\-_]+[^\W\d_]|([^\W\d_])\1\1", re.UNICODE)
LEXICON = {"idiot ": 3.0, "fool": 2.0}


def place(name):
    return toxicity.FEATURES.index(name)


def test_obfuscation_is_counted_as_before():
    dice = random.Random(3)
    for _ in range(3000):
        text = "".join(dice.choice("aab1_2$. -!éÉ") for _ in range(dice.randrange(25)))
        row = toxicity.measure(text, toxicity.Weights(LEXICON))
        words = max(1, len(re.findall(r"\w+", text)))
        assert row[place("obfuscated")] == sum(1 for _ in PLAIN.finditer(text)) / words, text


def test_second_person_near_a_hit():
    dice = random.Random(5)
    for _ in range(300):
        words = [dice.choice(["you", "idiot", "foolish", "x", "y", "z", "word"]) for _ in range(dice.randrange(60))]
        row = toxicity.measure(" ".join(words), toxicity.Weights(LEXICON))
        hits = [k for k, w in enumerate(words) if w in ("idiot", "foolish")]
        near = sum(w == "you" and any(abs(k - h) <= toxicity.NEAR for h in hits) for k, w in enumerate(words))
        assert row[place("second_near_hit")] == near / max(1, len(words))


def test_long_runs_take_seconds():
    started = time.time()
    for text in ("7" * 1_000_000, "_" * 1_000_000, "a" + "1." * 500_000 + "b", "you idiot " * 100_000, "$" * 1_000_000):
        assert len(toxicity.measure(text, toxicity.Weights(LEXICON))) == len(toxicity.FEATURES)
    assert time.time() - started < 20
