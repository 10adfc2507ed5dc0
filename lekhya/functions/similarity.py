"""Keys and similarity of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekhya.functions.numbers import NUKTA
from lekhya.functions.text import DEVANAGARI_DIGITS

# Number words that compare equal to digits.
NUMBER_FORMS = (
    ("शून्य", "0"), ("एक", "1"), ("दो", "2"), ("तीन", "3"), ("चार", "4"), ("पांच", "5"), ("पाँच", "5"), ("छह", "6"), ("सात", "7"),
    ("आठ", "8"), ("नौ", "9"), ("दस", "10"), ("ग्यारह", "11"), ("बारह", "12"), ("तेरह", "13"), ("चौदह", "14"), ("पंद्रह", "15"),
    ("पन्द्रह", "15"), ("सोलह", "16"), ("सत्रह", "17"), ("अठारह", "18"), ("उन्नीस", "19"), ("बीस", "20"), ("तीस", "30"),
    ("चालीस", "40"), ("पचास", "50"), ("साठ", "60"), ("सत्तर", "70"), ("अस्सी", "80"), ("नब्बे", "90"), ("सौ", "100"),
    ("हजार", "1000"), ("हज़ार", "1000"),
)
#: Vowel signs and the like that a rough sound key leaves out.
MATRA_RANGE = "[ा-ौॕ-ॗॢॣ]"
# Letters of one sound class for the spelling key, then signs that it leaves out.
SOUND_CLASSES = (
    ("कख", "K"), ("गघ", "G"), ("चछ", "C"), ("जझ", "J"), ("टठतथ", "T"), ("डढदध", "D"), ("पफ", "P"), ("बभ", "B"), ("य", "Y"), ("र", "R"),
    ("ल", "L"), ("व", "V"), ("शषस", "S"), ("ह", "H"), ("म", "M"), ("नणञङँ", "N"), ("अआ", "A"), ("इई", "I"), ("उऊ", "U"), ("एऐ", "E"),
    ("ओऔ", "O"), ("ऋ", "R"),
)
SILENT = "ािीुूृेैोौंः़्"
# Signs that a spelling of a vowel consists of.
MATRAS = "ािीुूृेैोौंँः"
#: Dependent marks that the consonant skeleton leaves out.
DEPENDENT = "[ऺ-़ा-ॏॕ-ॗॢॣ]"


def numeric_form(c: Column) -> Column:
    """Devanagari digits as ASCII; a whole word for a number as its digits."""
    ascii_digits = F.translate(c, DEVANAGARI_DIGITS, "0123456789")
    table = F.create_map(*[F.lit(x) for p in NUMBER_FORMS for x in p])
    return F.coalesce(table[ascii_digits], ascii_digits)


def comparison_key(token: Column) -> Column:
    """Key under which two tokens count as the same word: numbers, no nukta, chandrabindu as anusvara."""
    return F.translate(numeric_form(token), "ँ" + NUKTA, "ं")


def rough_key(token: Column) -> Column:
    """comparison_key without vowel signs and with runs of a character as one."""
    return F.regexp_replace(F.regexp_replace(comparison_key(token), MATRA_RANGE, ""), r"(.)\1+", "$1")


def similar(a: Column, b: Column, distance: int = 2) -> Column:
    """Same key or rough key, or, for tokens of three or more characters, within the edit distance."""
    near = (F.least(F.length(a), F.length(b)) > 2) & (F.levenshtein(a, b, distance) >= 0)
    return (a != "") & (b != "") & ((comparison_key(a) == comparison_key(b)) | (rough_key(a) == rough_key(b)) | near)


def skeleton(c: Column) -> Column:
    return F.regexp_replace(c, DEPENDENT, "")


def matra_signature(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{MATRAS}]", "")


def matra_error(word: Column, other: Column) -> Column:
    """Different words of one skeleton that differ in their vowel signs."""
    return (word != "") & (other != "") & (word != other) & (skeleton(word) == skeleton(other)) & (matra_signature(word) != matra_signature(other))


def sound_key(c: Column) -> Column:
    """Consonant classes without signs; other characters stay."""
    return F.translate(c, "".join(k for k, _ in SOUND_CLASSES) + SILENT, "".join(v * len(k) for k, v in SOUND_CLASSES))


def sounds_like(a: Column, b: Column, distance: int = 1) -> Column:
    x, y = sound_key(a), sound_key(b)
    return (x != "") & (y != "") & (F.levenshtein(x, y, distance) >= 0)
