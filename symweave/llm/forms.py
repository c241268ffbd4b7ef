"""Forms of characters: what is invisible, and which letters look the same.

The tables name what a reader cannot tell apart on the screen. Letters that merely resemble each other
(``l`` and ``1``, ``O`` and ``0``, ``rn`` and ``m``) are different here.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable

# For each Latin letter the letters of other scripts, or of phonetic use, drawn like it.
LOOK_ALIKES = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
# Signs drawn like another sign once compatibility forms are gone.
SIGNS = {"\u2010": "-", "\u02bc": "\u2019"}
# Ignorable characters that are no format characters (general category Cf).
IGNORABLE = "".join(map(chr, (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10))))

#: Kinds of compatibility form that look the same apart from width and style; raised, lowered, circled or
#: fractional forms differ visibly and stay.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>")


@functools.cache
def ignorable_pattern() -> re.Pattern[str]:
    """Matches runs of characters that leave no mark on the screen."""
    cf = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cf")
    return re.compile("[" + re.escape(cf + IGNORABLE) + "]+")


def _same_look(c: str) -> str:
    """One character with those compatibility forms undone that do not show."""
    d = unicodedata.decomposition(c)
    if not d.startswith("<"):
        return c
    kind, *codes = d.split()
    if kind not in SAME_LOOK:
        return c
    return "".join(_same_look(chr(int(x, 16))) for x in codes)


@functools.cache
def _compatible_char(c: str) -> str:
    """What stands for a character once invisible differences are gone; nothing for an ignorable one."""
    if ignorable_pattern().fullmatch(c):
        return ""
    out = _same_look(c)
    if out != c and out.strip() != out and len(out) > 1:  # a spacing accent: blank and mark
        out = c
    return "".join(SIGNS.get(x, x) for x in out)


_LATIN = {ord(x): latin for latin, others in LOOK_ALIKES.items() for x in others}


@functools.cache
def _latin_char(c: str) -> str:
    """A composed character in its Latin shape."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", c).translate(_LATIN))


def _replaced(text: str, new: Callable[[str], str]) -> str:
    """Every character beyond ASCII replaced. A text has few different ones, so each is looked up once."""
    changed = {c: x for c in set(text) if c > "\x7f" and (x := new(c)) != c}
    if len(changed) > 24:
        return text.translate({ord(c): x for c, x in changed.items()})
    for c in sorted(changed, key=lambda c: (changed[c] != "", c)):  # what vanishes goes first
        text = text.replace(c, changed[c])
    return text


def compatible(text: str) -> str:
    """Composed text without ignorable characters and without width, font and ligature forms.

    A blank of any width becomes one blank; several blanks stay several. Line ends become ``\\n``.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", _replaced(text, _compatible_char))
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() else text.replace("\u2028", "\n").replace("\u2029", "\n")


def skeleton(text: str) -> str:
    """The text as it looks: every letter in its Latin shape where it has one. Equal skeletons look the same."""
    text = compatible(text)
    if text.isascii():
        return text
    out = _replaced(text, _latin_char)
    return text if out == text else unicodedata.normalize("NFC", out)
