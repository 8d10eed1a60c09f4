"""Shared by the tests of the corpus operators."""

import os
import random

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"

WORDS = [a + b + c for a in ("th", "en", "or", "st") for b in ("an", "er", "ou") for c in ("", "ing", "ble", "ti")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))
