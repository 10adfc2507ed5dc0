"""Text forms shared by the llm operators: JVM-side expressions and their Python twins.

Every table below is either derived from a Unicode rule or a short list of fixed values.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that leave no mark on screen.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"

# White space other than the plain kinds (space, tab, line breaks).
WIDE_SPACES = "               　"

# Letters of other scripts drawn like a Latin letter, with that letter.
LOOKALIKE = (
    ("а", "a"), ("с", "c"), ("ԁ", "d"), ("е", "e"), ("һ", "h"), ("і", "i"),
    ("ј", "j"), ("ӏ", "l"), ("о", "o"), ("р", "p"), ("ԛ", "q"), ("ѕ", "s"),
    ("ԝ", "w"), ("х", "x"), ("у", "y"), ("ѵ", "v"), ("А", "A"), ("В", "B"),
    ("С", "C"), ("Е", "E"), ("Н", "H"), ("І", "I"), ("Ј", "J"), ("К", "K"),
    ("М", "M"), ("О", "O"), ("Р", "P"), ("Ѕ", "S"), ("Т", "T"), ("Х", "X"),
    ("Ү", "Y"), ("ο", "o"), ("ν", "v"), ("ρ", "p"), ("ι", "i"), ("Α", "A"),
    ("Β", "B"), ("Ε", "E"), ("Η", "H"), ("Ι", "I"), ("Κ", "K"), ("Μ", "M"),
    ("Ν", "N"), ("Ο", "O"), ("Ρ", "P"), ("Τ", "T"), ("Υ", "Y"), ("Χ", "X"),
    ("Ζ", "Z"), ("ո", "n"), ("ս", "u"), ("օ", "o"), ("հ", "h"), ("ք", "p"),
    ("զ", "q"), ("ց", "g"), ("ı", "i"), ("ɑ", "a"), ("ɡ", "g"),
)

# Devanagari letter sequences drawn like one letter.
SEQUENCES = (
    ("अा", "आ"), ("अो", "ओ"), ("अौ", "औ"),
    ("अॉ", "ऑ"), ("आे", "ओ"), ("आै", "औ"),
    ("आॅ", "ऑ"), ("एे", "ऐ"), ("एॅ", "ऍ"),
    ("अॅ", "ॲ"), ("ाे", "ो"), ("ाै", "ौ"),
    ("ाॅ", "ॉ"),
)

#: Letters with a nukta that Unicode also has as one code point, by decomposition rule.
NUKTA = tuple((chr(c), unicodedata.normalize("NFD", chr(c)))
              for c in (0x929, 0x931, 0x934, *range(0x958, 0x960)))
#: Latin ligatures, by compatibility rule.
LIGATURES = tuple((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xFB00, 0xFB07))
#: Full-width forms, by offset.
FULLWIDTH = tuple((chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F))


def _pairs(*groups: tuple) -> tuple[str, str]:
    flat = [p for g in groups for p in g]
    return "".join(a for a, _ in flat), "".join(b for _, b in flat)


_SPACES = tuple((c, " ") for c in WIDE_SPACES)
LOOK_FROM, LOOK_TO = _pairs(LOOKALIKE, FULLWIDTH, _SPACES)


def look_form(c: Column) -> Column:
    """The text with look-alike characters and sequences mapped to one form, without invisible ones.

    Composed and decomposed marks stay as stored; a Unicode collation treats them alike. Null stays null.
    """
    out = F.translate(c, LOOK_FROM + INVISIBLE, LOOK_TO)
    mapped = out
    for a, b in (*LIGATURES, *NUKTA, *SEQUENCES):
        mapped = F.replace(mapped, F.lit(a), F.lit(b))
    # few texts have any of these, and one pattern tells which
    return F.when(out.rlike("|".join(a for a, _ in (*LIGATURES, *NUKTA, *SEQUENCES))), mapped).otherwise(out)


def _bases() -> dict[str, str]:
    """Composed letters with the letter they are built on, by canonical decomposition."""
    out = {}
    for c in (*range(0xC0, 0xAC00), *range(0xF900, 0x10000)):
        d = unicodedata.decomposition(chr(c))
        if d and not d.startswith("<"):
            out[chr(c)] = unicodedata.normalize("NFD", chr(c))[0]
    return out


_BASES = _bases()


def rough_form(c: Column) -> Column:
    """A key that texts which are alike under a Unicode collation share: base letters alone, no marks, digits or Hangul
    (whose syllables are several letters otherwise stored). Others may share it, too."""
    return F.regexp_replace(F.translate(c, "".join(_BASES), "".join(_BASES.values())), r"[^\p{L}]|\p{IsHangul}", "")


_MAP = str.maketrans(dict(zip(LOOK_FROM, LOOK_TO)) | dict.fromkeys(INVISIBLE))
_PUNCT = re.compile(r"[^\w\sऀ-ॣ०-ॿ̀-ͯ]|_")


def same_words(text: str | None) -> list[str]:
    """Words of a text for comparison: case, punctuation, spacing and look-alikes don't count."""
    if not text:
        return []
    out = text if text.isascii() else unicodedata.normalize("NFKC", text.translate(_MAP)).translate(_MAP)
    if not out.isascii():
        for a, b in SEQUENCES:
            if a in out:
                out = out.replace(a, b)
    return _PUNCT.sub("", out.lower()).split()
