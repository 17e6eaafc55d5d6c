"""Words of a text as comparisons see them: no case, punctuation, spacing, markup or invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters that take no room on a page: soft hyphen, zero-width characters, direction marks, variation selectors.
INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF])
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]{0,500}\)")
_ESCAPE = re.compile(r"\\(?:[nrtbf]|u[0-9a-fA-F]{4})")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """`text` in lower case without markup and invisible characters (compatibility forms folded)."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(INVISIBLE))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words of a text; null and empty texts have none."""
    return _WORD.findall(plain(text)) if text else []
