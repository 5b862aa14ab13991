"""Words and characters as the text problems count them."""

from __future__ import annotations

import re
import unicodedata

_MARKS = re.compile(
    "[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\ufb1e]+"
)
_FORMAT = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")
_WORD = re.compile(r"[^\W_]+")
_COMPOSED = re.compile("[\u00c0-\u024f\u1e00-\u1fff\u0374-\u03ff\u0400-\u0482\u048a-\u052f\ufb1d-\ufb4f\u0900-\u0dff\uac00-\ud7af]")


def bare(text: str) -> str:
    """Case folded, combining marks set aside, base letters kept."""
    text = text.casefold()
    if text.isascii():
        return text
    if _COMPOSED.search(text):
        text = unicodedata.normalize("NFD", text)
    return _MARKS.sub("", text)


def words(text: str) -> list[str]:
    """Runs of letters and digits, case and combining marks set aside."""
    return _WORD.findall(bare(text))


def without_signs(text: str) -> str:
    """The text without invisible format signs."""
    return text if text.isascii() else _FORMAT.sub("", text)


_TO_MAP = re.compile("[Ͱ-ԯ℀-ↈⰀ-ⷿ　-㏿Ꙁ-ꟿﬀ-﷿︰-￮\U0001d400-\U0001d7ffװ-ײİ-ſǄ-ǳµ]")
_table: dict[int, str] = {}


def plain(text: str) -> str:
    """Case, marks, invisible signs, widths, joined letters and look-alike letters set aside (the mapping of problem 5)."""
    if text.isascii():
        return text.lower()
    text = _FORMAT.sub("", text)
    if _TO_MAP.search(text):
        if not _table:
            from .canonical import mappings

            one, many = mappings()
            _table.update({ord(k): v for k, v in (one | many).items()})
        text = text.translate(_table)
    return bare(text)


def plain_words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def alike(a: str, b: str) -> bool:
    """One word misspelt: at most a third of the longer word's letters edited, one at least allowed."""
    if a == b:
        return True
    most = max(1, max(len(a), len(b)) // 3)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most
