"""Counts that tell prose from junk, for whole texts, and the votes of heuristic rules on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from arborlog.llm import textkit

_LEAD = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_STOP = np.isin(np.arange(256), np.frombuffer(b".?!", dtype=np.uint8))
# Frequent small words of English, German, French and Spanish.
_SMALL = (
    "the of and to in is was for on that with it as are be this by or at from "
    "der die das und ist ein eine mit von zu den des sich auf nicht als auch "
    "le la les des et est un une dans pour que du au sur par qui en "
    "el los las de y una por con para se no lo del al su"
).split()


_SMALL_HASHES = np.unique(textkit.Words(pa.array([" ".join(_SMALL)])).hashes())

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_letter_words", "n_small", "n_stops"]


def alike(owner: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """In order, the places whose hash may be found again in the same text; a few more than are. The text's number takes the key's top bits."""
    bits = np.uint64(max(1, int(texts).bit_length()))
    key = (owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    return np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]) if len(key) else np.zeros(0, dtype=np.int64)


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of true flags in each text; at: where each starts, and the end."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def counts(column: pa.Array) -> tuple[dict[str, np.ndarray], textkit.Words, np.ndarray]:
    """COUNTS for each text, the words and their quick hashes."""
    w = textkit.Words(column)
    h, n, owner = w.hashes(), len(w.counts), w.owner()
    inside = _LEAD[w.data] & ~textkit.SPACE[w.data]
    out = {"n_words": w.counts, "word_chars": per_text(inside, w.at), "n_symbols": per_text(_SYMBOL[w.data], w.at), "n_upper": per_text(_UPPER[w.data], w.at), "n_letters": per_text(_LETTER[w.data] & inside, w.at)}
    letters = np.concatenate([[0], np.cumsum(_LETTER[w.data], dtype=np.int64)])
    out["n_letter_words"] = per_text(letters[w.ends] > letters[w.starts], w.first)
    out["n_small"] = per_text(_SMALL_HASHES[np.minimum(np.searchsorted(_SMALL_HASHES, h), len(_SMALL_HASHES) - 1)] == h, w.first)
    out["n_stops"] = per_text(_STOP[w.data[w.ends - 1]] if len(w.ends) else np.zeros(0, dtype=bool), w.first)
    # lines with a word: the line of each word that isn't on the line of the word before it
    breaks = np.flatnonzero(w.data == 10)
    line = np.searchsorted(breaks, w.starts)
    head = np.ones(len(line), dtype=bool)
    head[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    line, own = line[head], owner[head]
    begin = np.maximum(w.at[own], np.concatenate([[-1], breaks])[line] + 1)
    end = np.minimum(w.at[own + 1], np.concatenate([breaks, [len(w.data)]])[line])
    out["n_lines"] = np.bincount(own, minlength=n)
    out["n_dup_lines"] = np.zeros(n, dtype=np.int64)
    maybe = alike(own, textkit.span_hashes(w.data, begin, end), n)
    if len(maybe):
        same, lines = textkit.coded(w.data, begin[maybe], end[maybe])
        distinct = pd.unique(own[maybe] * len(lines) + same) // len(lines)  # the text of each distinct line
        out["n_dup_lines"] = np.bincount(own[maybe], minlength=n) - np.bincount(distinct, minlength=n)
    # words in windows of three that are found again
    at = np.flatnonzero(textkit.fits(w, 3))
    at = at[alike(owner[at], textkit.windows(h, 3, at), n)]
    run = textkit.pairs(owner[at], textkit.Covered(w, at, 3).windows)
    again = at[np.bincount(run)[run] > 1] if len(at) else at
    covered = np.zeros(len(h), dtype=bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = per_text(covered, w.first)
    return out, w, h


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


#: Rules: name, then (numerator, denominator, bad below, good from, good to, bad above); a share between good and bad abstains.
RULES = [
    ("length", "n_words", None, 50, 100, 1e9, 1e12),
    ("word_length", "word_chars", "n_words", 3.0, 3.5, 9.0, 11.0),
    ("symbols", "n_symbols", "n_words", -1.0, -1.0, 0.02, 0.1),
    ("duplicate_lines", "n_dup_lines", "n_lines", -1.0, -1.0, 0.1, 0.3),
    ("repeated_words", "n_repeat_words", "n_words", -1.0, -1.0, 0.2, 0.5),
    ("capitals", "n_upper", "n_letters", -1.0, -1.0, 0.12, 0.3),
    ("letter_words", "n_letter_words", "n_words", 0.8, 0.9, 2.0, 3.0),
    ("small_words", "n_small", "n_words", 0.02, 0.06, 0.8, 0.95),
    ("sentence_ends", "n_stops", "n_words", 0.002, 0.01, 0.3, 0.5),
]


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """1 (good), -1 (bad) or 0 (abstains) of each rule on each text; texts without words get no votes but length's."""
    out = np.zeros((len(c["n_words"]), len(RULES)), dtype=np.int8)
    for i, (_, top, bottom, low, good, fine, high) in enumerate(RULES):
        x = c[top] / np.maximum(1, c[bottom]) if bottom else c[top].astype(float)
        out[:, i] = np.where((x < low) | (x > high), -1, np.where((x >= good) & (x <= fine), 1, 0))
        if bottom:
            out[c[bottom] == 0, i] = 0
    return out
