"""A text encoder without a model: hashed words, as a stand-in for an outside encoder in jobs and tests."""

from __future__ import annotations

import hashlib
import re

import numpy as np

#: Numbers of a vector, and what a word is.
DIMENSIONS, WORD = 64, re.compile("[a-z0-9_]+")


def hashed(texts: list[str]) -> np.ndarray:
    """A row a text: each word of its ASCII letters in lower case adds 1 or -1 at a place; both follow from the word's MD5."""
    out = np.zeros((len(texts), DIMENSIONS))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for row, text in zip(out, texts):
        for word in WORD.findall(text.translate(lower)):
            sign, place = hashlib.md5(word.encode()).hexdigest()[:2]
            row[int(place, 16) * 4 + int(sign, 16) // 4] += 1 if int(sign, 16) % 2 else -1
    return out
