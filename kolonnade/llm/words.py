"""Words of a text, as compared between texts."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

INLINE = "a|abbr|b|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var"
BLOCK = "article|aside|blockquote|body|br|caption|dd|div|dl|dt|figure|footer|h[1-6]|head|header|hr|html|img|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
_ATTRS = r"(?:\s+[a-zA-Z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?"
_INLINE_TAG = re.compile(rf"</?(?:{INLINE})(?:{_ATTRS})>", re.I)
_BLOCK_TAG = re.compile(rf"</?(?:{BLOCK})(?:{_ATTRS})>|<!--.*?-->", re.I | re.S)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:https?:|mailto:|/|#|\.)[^()\s]*\)")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]+);")
#: Characters that show nothing: format characters, variation selectors, joiners, fillers.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Case folded NFKC text without markup and invisible characters; punctuation stays."""
    if "<" in text:
        text = _BLOCK_TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold()


def words(text: str) -> list[str]:
    """Runs of letters and digits of `plain(text)`."""
    return WORD.findall(plain(text))


class Hasher:
    """64-bit hashes of words, remembered for as many words as fit `limit`."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = np.empty(len(ws), np.uint64)
        for i, w in enumerate(ws):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of `n` words, by the place where they begin."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out
