"""Words of a text: lower case, width and compatibility forms folded, characters without
ink and mark-up removed, punctuation and white space between words. Each Chinese
character is a word."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_INK = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]+")
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]{0,200}>", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_ENTITY = re.compile(r"&(?:nbsp|amp|lt|gt|quot|#\d+|#x[0-9a-f]+);", re.I)


def words(text: str, markup: bool = False) -> list[str]:
    """``markup``: drop tags, comments, link targets and marks inside words as well."""
    if not text.isascii():
        text = _INK.sub("", text)
        text = unicodedata.normalize("NFKC", text)
    if markup:
        if "<" in text:
            text = _TAG.sub("", text)
        if "](" in text:
            text = _LINK.sub("]", text)
        if "&" in text:
            text = _ENTITY.sub(" ", text)
        text = text.replace("*", "").replace("`", "").replace("~~", "")
    return _WORD.findall(text.lower())


# words as numbers: powers of an odd base make the hash of a word independent of where it stands
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
_KINDS: list[np.ndarray] = []


def _kinds(codes: np.ndarray) -> np.ndarray:
    """0: between words, 1: in a word, 2: a word by itself."""
    if not _KINDS:
        kind = np.fromiter((chr(n).isalnum() for n in range(1 << 16)), np.uint8, 1 << 16)
        kind[0x3400:0xA000] = 2
        _KINDS.append(kind)
    if codes.dtype == np.uint8 or not len(codes) or codes.max() < 1 << 16:
        return _KINDS[0][codes]
    out = _KINDS[0][np.minimum(codes, 0xFFFF)]
    far = codes >= 1 << 16
    out[far] = [chr(n).isalnum() for n in codes[far]]
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 4096), base, np.uint64)])
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each of ``words(text)``, in their order, without making the words. A
    word of over a million characters counts as several."""
    if text.isascii():
        codes = np.frombuffer(text.lower().encode(), np.uint8)
    else:
        text = unicodedata.normalize("NFKC", _INK.sub("", text)).lower()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds(codes)
    one = kind == 1
    before, after = np.zeros(len(one), bool), np.zeros(len(one), bool)
    before[1:], after[:-1] = one[:-1], one[1:]
    alone = kind == 2
    if len(codes) <= _PIECE:
        return _hashed(codes, np.flatnonzero(alone | one & ~before), np.flatnonzero(alone | one & ~after) + 1)
    out, at = [], 0
    starts = np.flatnonzero(alone | one & ~before)
    while at < len(codes):  # pieces end where a word begins, if one does
        k = np.searchsorted(starts, at + _PIECE, side="right") - 1
        end = int(starts[k]) if k >= 0 and starts[k] > at and at + _PIECE < len(codes) else min(at + _PIECE, len(codes))
        first, last = alone[at:end] | one[at:end] & ~before[at:end], alone[at:end] | one[at:end] & ~after[at:end]
        if end > at and one[at] and before[at]:
            first[0] = True
        if end < len(codes) and one[end - 1]:
            last[-1] = True
        out.append(_hashed(codes[at:end], np.flatnonzero(first), np.flatnonzero(last) + 1))
        at = end
    return np.concatenate(out)


def _hashed(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], dtype=np.uint64, out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)
