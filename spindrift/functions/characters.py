"""Classes of characters by category and name, as ranges of code points, for regular expressions of the JVM.

Made by rule from Python's own tables once a process, since the JVM's script and digit classes differ from these."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

#: Fixed: the categories that a Latin piece's characters beyond ASCII may have.
CATEGORIES = set("Lu Ll Lt Lm Nd No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs".split())


def ranges(test: Callable[[str], bool]) -> list[tuple[int, int]]:
    """(first, last) of each run of code points that pass the test."""
    out: list[tuple[int, int]] = []
    for c in range(0x110000):
        if test(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


def as_class(runs: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@cache
def latin() -> str:
    """ASCII, and what is Latin by name and of the fixed categories."""
    return as_class(ranges(lambda c: c.isascii() or (unicodedata.category(c) in CATEGORIES and "LATIN" in unicodedata.name(c, ""))))


@cache
def digit() -> str:
    """Digits of any kind, raised and circled ones too."""
    return as_class(ranges(str.isdigit))
