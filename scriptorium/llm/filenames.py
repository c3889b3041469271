"""The normal form of a file name, and the keys under which near-equal names meet.

A name says a subject, a topic, a kind of document, a year and a part. Folder, ending,
encoding, width, look-alike letters, case, separators, order, and marks of copy,
version, sender or state are taken off; words are sorted, a run of Chinese characters is
rotated to its smallest rotation, so a moved block makes no difference. Names whose
normal forms are equal, or whose words differ by one slip each in at most two words
(one in a run of Chinese characters), are the same document. Numbers and short words
(year, part) must be equal, and so must all words but the slipped ones.

Every form is filed under keys: the whole form, and the form without one or two of its
long words (without one of its Chinese characters). Where fewer than two long words would
be left, the words left out stay in the key with one letter left out, since what is left
would be shared by too many names. Two forms that are the same share a key, so equal
keys find all of them without comparing all pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import xxhash

_ENDING = re.compile(r"(?i)\s*\.+\s*(?:md|mdx|markdown|txt|rst|pdf|docx?|xlsx?|pptx?|csv|html?|rtf|odt|json|zip)\s*$")
_TOKEN = re.compile(r"[一-鿿]+|[^\W\d_]+|\d+")
_ZH = re.compile(r"[一-鿿]")

# fixed values: marks of copy, version, sender and state
_MARKS_ZH = re.compile(r"(?:第[一二三四五六七八九十\d]+版|最终版|修订版|修订稿|定稿|终稿|草稿|草案|初稿|副本|复件|扫描件|清洁版|转发|回复|答复|新版|新建)")
_VERSION = re.compile(
    r"(?<![a-z])(?:v|ver|version|rev|revision)[ ._-]*\d+(?:[._]\d+)*(?![a-z])|(?<![a-z])(?:final|draft|copy|clean|scan)[ ._-]?\d{0,2}(?![a-z\d])"
    r"|\(\s*\d{1,2}\s*\)|（\s*\d{1,2}\s*）"
)
_MARKS = frozenset("copy of final draft new re fw fwd aw wg scan scanned clean signed approved old latest final2 kopie von copia de".split())


def _shown(text: str, looks) -> str:
    if text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFKC", text if looks is None else looks.rewrite(text))


def normal(name: str, looks=None) -> str:
    """Words parted by blanks; empty if nothing is left."""
    text = _shown(name, looks)
    if "%" in text:
        for _ in range(2):
            text = unquote(text)
        text = _shown(text, looks)
    plain = text.isascii()
    if not plain:
        text = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) not in ("Mn", "Cf"))
    text = text.replace("\\", "/").rpartition("/")[2].strip().lower()
    for _ in range(2):
        text = _ENDING.sub("", text)
    text = _VERSION.sub(" ", text.replace("_", " "))
    if not plain:
        text = _MARKS_ZH.sub(" ", text)
    words = _TOKEN.findall(text)
    zh = "".join(w for w in words if _ZH.match(w))
    rest = [w for w in words if not _ZH.match(w)]
    lean = [w for w in rest if w not in _MARKS] or rest
    if zh:
        zh = min(zh[k:] + zh[:k] for k in range(len(zh)))
    return " ".join(([zh] if zh else []) + sorted(lean))


class _Hashes(dict):
    def __missing__(self, text: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[text] = xxhash.xxh64_intdigest(text)
        return h


_HASH = _Hashes()
_FULL = (1 << 64) - 1


def _key(n: int, salt: int) -> int:
    n = ((n + salt) * 0x9E3779B97F4A7C15) & _FULL
    n ^= n >> 32
    return n - (1 << 64) if n >> 63 else n


def _slips(word: str) -> bool:
    return len(word) > 2 and not word[0].isdigit() and bool(word.strip("ivx"))  # a number states a part


def keys(form: str) -> Iterator[int]:
    """The keys of a normal form; the first is that of the whole form. A key is the sum of
    the hashes of the words left (of the neighbours left, for Chinese characters)."""
    yield _key(_HASH[form], 0)
    words = form.split(" ")
    zh = words[0] if _ZH.match(words[0]) else ""
    if zh:
        if len(zh) > 5:
            pair = [_HASH[zh[k - 1] + zh[k]] for k in range(len(zh))]
            whole = sum(pair) + _HASH[" ".join(words[1:])]
            yield _key(whole, 3)
            for k in range(len(zh)):
                after = (k + 1) % len(zh)
                yield _key(whole - pair[k] - pair[after] + _HASH[zh[k - 1] + zh[after]], 3)
        return
    whole = sum(map(_HASH.__getitem__, words))
    long = [w for w in words if _slips(w)]
    for a in range(len(long)):
        for left in _near(long[a]) if len(long) < 3 else [0]:
            yield _key(whole - _HASH[long[a]] + left, 1)
        for b in range(a + 1, len(long)):
            rest = whole - _HASH[long[a]] - _HASH[long[b]]
            if len(long) > 3:
                yield _key(rest, 2)
            else:
                for x in _near(long[a]):
                    for y in _near(long[b]):
                        yield _key(rest + x + y, 2)


def splits(form: str, key: int) -> list[int]:
    """What forms that share a key with whole words left out, and are the same, share too: a hash
    of one of the words left out. [0] for keys of other kinds, which few forms share."""
    words = form.split(" ")
    long = [] if _ZH.match(form) else [w for w in words if _slips(w)]
    if len(long) < 3:
        return [0]
    whole, out = sum(map(_HASH.__getitem__, words)), []
    for a in range(len(long)):
        if _key(whole - _HASH[long[a]], 1) == key:
            out += _near(long[a])
        if len(long) > 3:
            for b in range(a + 1, len(long)):
                if _key(whole - _HASH[long[a]] - _HASH[long[b]], 2) == key:
                    out += _near(long[a]) + _near(long[b])
    return [n - (1 << 64) if n >> 63 else n for n in dict.fromkeys(out)] or [0]


def _near(word: str) -> list[int]:
    """Hashes two words share if they are one slip apart: of the word with one letter left
    out, or, of a long word, of its beginning and its end (one of which a slip spares)."""
    size, out = len(word), []
    if size <= 12:
        out = [word] + [word[:k] + word[k + 1 :] for k in range(size)]
    if size >= 12:
        for m in {(size - 1) // 2, (size - 2) // 2}:
            out += [f"{m}<{word[:m]}", f"{m}>{word[size - m :]}"]
    return [_HASH["~" + x] for x in dict.fromkeys(out)]


def one_slip(a: str, b: str) -> bool:
    """At most one letter inserted, left out, replaced, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and len(y) > 1 and x[2:] == y[2:])


def same(a: str, b: str) -> bool:
    """Whether two normal forms name the same document (an equivalence only when closed)."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if bool(_ZH.match(a)) != bool(_ZH.match(b)):
        return False
    if _ZH.match(a):
        p, q = x[0], y[0]
        if x[1:] != y[1:] or abs(len(p) - len(q)) > 1 or min(len(p), len(q)) < 6:
            return False
        if len(p) == len(q):  # a swapped or replaced character
            swapped = sorted(p) == sorted(q)
            return any(_zh_slip(p, q[k:] + q[:k], swapped) for k in range(len(q)))
        if len(p) < len(q):
            p, q = q, p
        return any(_least(p[k + 1 :] + p[:k]) == q and (p[k] == p[k - 1]) for k in range(len(p))) or any(
            _least(p[k + 1 :] + p[:k]) == q for k in range(len(p)))
    if len(x) != len(y):
        return False
    only_x, only_y = list(x), []
    for w in y:
        if w in only_x:
            only_x.remove(w)
        else:
            only_y.append(w)
    if len(only_x) > 2 or not all(map(_slips, only_x + only_y)):
        return False
    if len(only_x) == 1:
        return one_slip(only_x[0], only_y[0])
    (p, q), (r, s) = only_x, only_y
    return (one_slip(p, r) and one_slip(q, s)) or (one_slip(p, s) and one_slip(q, r))


def _winnow(form: str) -> tuple[frozenset[int], int]:
    """The winnowed three-letter runs of a form's words (of two neighbours round a run of
    Chinese characters): of every two next to each other the one with the lesser hash; and
    how many of them slips can change."""
    found, most = set(), []
    for word in form.split(" "):
        if _ZH.match(word):
            grams = [_HASH[word[k - 1] + word[k]] for k in range(len(word))]
            grams.append(grams[0])
        else:
            grams = [_HASH[word[k : k + 3]] for k in range(max(1, len(word) - 2))]
        own = {min(grams[k : k + 2]) for k in range(max(1, len(grams) - 1))}
        most.append(min(len(own), 5))
        found |= own
    return frozenset(found), sum(sorted(most)[-2:])


class _Winnowed(dict):
    def __missing__(self, form: str) -> tuple[frozenset[int], int]:
        if len(self) > 200_000:
            self.clear()
        out = self[form] = _winnow(form)
        return out


_WINNOWED = _Winnowed()


def covers(a: str, b: str) -> bool:
    """Whether two forms share all winnowed runs but those that two slips can change."""
    (x, slips), (y, slips_y) = _WINNOWED[a], _WINNOWED[b]
    common = len(x & y)
    return common >= len(x) - slips and common >= len(y) - slips_y


def _least(text: str) -> str:
    return min(text[k:] + text[:k] for k in range(len(text)))


def _zh_slip(p: str, q: str, swapped: bool) -> bool:
    differ = [k for k in range(len(p)) if p[k] != q[k]]
    if swapped:
        return len(differ) == 2 and differ[1] - differ[0] in (1, len(p) - 1)
    return len(differ) == 1
