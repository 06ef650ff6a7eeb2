"""Cleaning of damaged text."""

from __future__ import annotations

import html
import re
import unicodedata

_TWICE = re.compile(r"[Â-ô][\u0080-¿]{1,3}")
#: A tag by its form, of any length: a name, attributes with or without values, an end; or a comment.
_TAG = re.compile(r"""</?[a-z][\w:-]*(?:\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)*\s*/?>|<![^<>]*>""")
_MARKS = re.compile(r"[̀-ͯ­​-‏﻿]")


def _once(m: re.Match[str]) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repaired(text: str) -> str:
    """Lower case, composed characters, without entities, tags and twice-encoded characters."""
    t = text
    if not t.isascii():
        t = _TWICE.sub(_once, t)
    t = t.lower()
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    return t if t.isascii() else unicodedata.normalize("NFC", t)


def bare(text: str) -> str:
    """``repaired`` without accents and soft hyphens."""
    t = repaired(text)
    return t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", t))
