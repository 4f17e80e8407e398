"""Statistics of whole texts that quality rules use; words stand between ASCII white space."""

from __future__ import annotations

import re

import numpy as np

from .common import WordHashes, mix, odd_constants

_C = odd_constants(3, 77)
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\r\x0b\x0c"
_ASCII = bytes(range(0x80))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")

#: Base counts, then the statistics that the trees see, in order.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "n_words",
    "mean_word_chars",
    "symbols_per_word",
    "dup_lines",
    "repeat_words",
    "upper_share",
    "digit_share",
    "distinct_words",
    "same_as_before",
    "letter_words",
    "marked_words",
)


def base_counts(text: bytes | None, words: WordHashes) -> tuple[list[int], np.ndarray, list[bytes]]:
    """The five counts of BASE, with the word hashes and words."""
    if not text:
        return [0, 0, 0, 0, 0], np.empty(0, np.uint64), []
    parts = text.split()
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    chars = len(text.translate(None, _SPACE + _CONTINUATION))
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += bool(line.strip(_SPACE))
        else:
            seen.add(line)
    h = words.array(parts)
    repeated = 0
    if len(h) >= 3:
        grams = mix(h[:-2] * _C[0] + h[1:-1] * _C[1] + h[2:] * _C[2])
        _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        often = times[back] >= 2
        hit = np.zeros(len(h), bool)
        for k in range(3):
            hit[k : k + len(often)] |= often
        repeated = int(hit.sum())
    return [len(parts), chars, symbols, again, repeated], h, parts


def letter_cases(text: bytes) -> tuple[int, int]:
    """Upper-case and lower-case letters, of all scripts."""
    upper = len(text) - len(text.translate(None, _UPPER))
    lower = len(text) - len(text.translate(None, _LOWER))
    other = text.translate(None, _ASCII).decode("utf-8", "ignore")
    return upper + sum(map(str.isupper, other)), lower + sum(map(str.islower, other))


def statistics(text: bytes | None, words: WordHashes) -> tuple[list[int], np.ndarray]:
    """The counts of BASE and the row of STATISTICS."""
    counts, h, parts = base_counts(text, words)
    n = counts[0]
    if not n:
        return counts, np.zeros(len(STATISTICS))
    upper, lower = letter_cases(text)
    digits = len(text) - len(text.translate(None, b"0123456789"))
    letters = sum(1 for w in parts if _LETTER.search(w))
    marked = sum(1 for w in parts if w[-2:] in (b"!!", b"??", b"**", b"$$", b"%%", b"&&", b"##"))
    row = [
        n,
        counts[1] / n,
        counts[2] / n,
        counts[3] / (1 + text.count(b"\n")),
        counts[4] / n,
        upper / max(1, upper + lower),
        digits / max(1, counts[1]),
        len(np.unique(h)) / n,
        float((h[1:] == h[:-1]).sum()) / n,
        letters / n,
        marked / n,
    ]
    return counts, np.array(row)
