"""Tagging of English words in Hindi text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekhya.functions.numbers import NUKTA, split_affixes
from lekhya.functions.text import nfkc, repair_mojibake

ROMAN_WORD = r"^[A-Za-z]+(?:[-'][A-Za-z]+)*$"
# Hindi words that are never tagged.
HINDI = "है हैं और में का की के को से पर यह वह मैं हम आप कि तो भी नहीं एक दो तीन दिन बात बातें सवाल".split()
# English words in Devanagari.
BORROWED = (
    "इंटरव्यू जॉब कंप्यूटर कम्प्यूटर फाइल फाइलें प्रॉब्लम ऑफिस फोन लैपटॉप ईमेल मेल मीटिंग मैनेजर टीम डेटा सिस्टम प्रोजेक्ट कोड "
    "लॉगिन पासवर्ड सॉफ्टवेयर हार्डवेयर क्लास फॉर्म नेटवर्क"
).split()
# Letter groups found in borrowed words.
HINTS = "इंटर जॉब कंप कम्प फाइल प्रॉब्ल ऑफ फोन लैप मेल मीट मैनेज टीम डेटा सिस्टम प्रोजेक्ट कोड लॉग पास सॉफ्ट हार्ड फॉर्म नेट ट्र ड्र कॉ ऑ".split()


def is_borrowed(core: Column, hindi: list[str] = HINDI) -> Column:
    """Whether a Devanagari word is an English one: known, else not Hindi and with a hint."""
    plain = F.replace(core, F.lit(NUKTA), F.lit(""))
    return plain.isin(BORROWED) | (~plain.isin(hindi) & plain.rlike("|".join(HINTS)))


def tag_english(c: Column, hindi: list[str] = HINDI) -> Column:
    """English words wrapped in [EN]..[/EN], punctuation left outside, tokens joined by single spaces.

    Blank text and tokens tagged already stay as they are. hindi: a bounded list of words that are never tagged;
    for lexicons that aren't bounded, tag by a join on tokens (operators.cleanup.tag_with_lexicon)."""
    text = nfkc(repair_mojibake(c))

    def tag(t: Column) -> Column:
        a = split_affixes(t)
        hit = a["core"].rlike(ROMAN_WORD) | is_borrowed(a["core"], hindi)
        wrapped = F.concat(a["leading"], F.lit("[EN]"), a["core"], F.lit("[/EN]"), a["trailing"])
        return F.when(t.rlike(r"\[EN\].*\[/EN\]"), t).when((a["core"] != "") & hit, wrapped).otherwise(t)

    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", c).otherwise(F.array_join(F.transform(tokens, tag), " "))
