"""Wildcard patterns and their regular expressions."""

from __future__ import annotations

import re


def has_wildcard(pattern: str) -> bool:
    return "*" in pattern


def glob_to_regex(pattern: str, anchored: bool = True) -> str:
    """``*`` any run, ``?`` one character, ``[...]`` a set; the rest is literal. Java and Python read the result alike."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = close
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    body = "".join(out)
    return f"(?s)^(?:{body})$" if anchored else f"(?s){body}"
