"""Text functions as Column expressions. Null input gives '' (or an empty array), as blank text does."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII = r"^[\x00-\x7F]*$"
# Character pairs that mark Devanagari read as Latin-1.
MOJIBAKE = "\\u00e0[\\u00a4\\u00a5]|\\u00ef\\u00bf\\u00bd"
ZERO_WIDTH = "\\u200b\\u200c\\u200d\\ufeff"
JOINERS = "\\u200c\\u200d\\ufeff"
DEVANAGARI_DIGITS = "".join(chr(0x966 + k) for k in range(10))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def once(f: Callable[..., Column], *values: Column) -> Column:
    """f(values) with each value worked out once per row, however often, or inside which lambda, f uses it."""
    held = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(held, lambda s: f(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def nfkc(c: Column) -> Column:
    """Compatibility normal form. Only texts beyond ASCII cross to Python; the rest pass as nulls."""
    return F.coalesce(_nfkc(F.when(~c.rlike(ASCII), c)), c)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 read as Latin-1 put right where the whole text can be; any failure leaves the text unchanged."""
    raw = F.when(blank(c).rlike(MOJIBAKE) & blank(c).rlike(r"^[\x00-\xFF]*$"), F.encode(c, "ISO-8859-1").cast("string"))
    return F.coalesce(F.try_validate_utf8(raw), blank(c))


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x{1C}-\x{1F}]+", " "))


def normalize_spaces(c: Column) -> Column:
    """Repaired, NFKC, danda and bar as spaces, white space collapsed."""
    return squeeze(F.translate(nfkc(repair_mojibake(c)), "।॥|", "   "))


def words(c: Column) -> Column:
    """Pieces between single spaces, none empty."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def whitespace_tokens(c: Column) -> Column:
    return words(normalize_spaces(c))


def normalize_transcript(c: Column) -> Column:
    """NFKC; joiners, danda and bar as spaces; only ASCII letters and digits and Devanagari kept."""
    kept = F.regexp_replace(nfkc(blank(c)), f"[{JOINERS}।॥|]", " ")
    return squeeze(F.regexp_replace(kept, r"(?U)[^0-9A-Za-zऀ-ॿ\s]", " "))


def normalize_word(c: Column) -> Column:
    """Form of a word for lexicon lookup: repaired, NFKC, joiners and other characters deleted, lower case."""
    out = F.regexp_replace(nfkc(repair_mojibake(c)), f"[{JOINERS}]", "")
    return F.lower(F.regexp_replace(out, r"[^0-9A-Za-zऀ-ॿ]+", ""))


def normalize_utterance(c: Column) -> Column:
    """Repaired, NFKC, zero-width characters as spaces, white space collapsed."""
    return squeeze(F.regexp_replace(nfkc(repair_mojibake(c)), f"[{JOINERS}]", " "))


def token_form(c: Column) -> Column:
    """A token of an utterance: other characters deleted, lower case (for text that is NFKC already)."""
    return F.lower(F.regexp_replace(c, r"[^0-9A-Za-zऀ-ॿ]+", ""))


def utterance_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(normalize_utterance(c), " "), token_form), lambda t: t != "")


def comparison_tokens(c: Column) -> Column:
    """Tokens of ASCII letters and digits and of Devanagari; all else separates them."""
    return words(squeeze(F.regexp_replace(normalize_spaces(c), r"[^0-9A-Za-z\u0900-\u097F]", " ")))


def content_characters(c: Column) -> Column:
    """Number of letters, digits and Devanagari characters."""
    return F.length(F.regexp_replace(blank(c), r"[^\p{L}\p{N}ऀ-ॿ]", ""))


def counted(tokens: Column) -> Column:
    """Sorted tokens, each with how many times it stood before: two arrays' multisets compare as sets of these."""
    number = lambda ts: F.transform(ts, lambda t, i: F.concat(t, F.lit("\u0001"), (i + 1 - F.array_position(ts, t)).cast("string")))
    return once(number, F.array_sort(tokens))


def dominant_fraction(tokens: Column) -> Column:
    """Share of the most frequent token; 0 without tokens."""
    most = lambda ts: F.array_max(F.transform(ts, lambda t, i: i + 2 - F.array_position(ts, t)))
    return F.when(F.size(tokens) > 0, once(most, F.array_sort(tokens)) / F.size(tokens)).otherwise(F.lit(0.0))


def longest_character_run(c: Column) -> Column:
    """Longest run of one character other than white space."""
    blocks = F.regexp_extract_all(blank(c), F.lit(r"((\S)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(blocks, F.length)), F.lit(0))


def truncate(c: Column, limit: int = 240) -> Column:
    t = normalize_spaces(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def digits(c: Column) -> Column:
    """Runs of digits of any script, with commas between them."""
    return F.regexp_extract_all(blank(c), F.lit(r"((?U)\d[\d,]*)"), F.lit(1))


def tagged_terms(c: Column) -> Column:
    """Texts between [EN] and [/EN]."""
    return F.regexp_extract_all(blank(c), F.lit(r"\[EN\](.*?)\[/EN\]"), F.lit(1))


def has_devanagari(c: Column) -> Column:
    return c.rlike(r"[ऀ-ॿ]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def has_digit(c: Column) -> Column:
    return c.rlike(r"(?U)\d")


def is_devanagari_token(c: Column) -> Column:
    return has_devanagari(c) & ~has_latin(c)


def is_roman_token(c: Column) -> Column:
    return has_latin(c) & ~has_devanagari(c)
