"""Spoken Hindi numbers as digits."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words for 0 to 99 in order, spellings of one number side by side.
UNITS = (
    ("शून्य",), ("एक",), ("दो",), ("तीन",), ("चार",), ("पांच", "पाँच"), ("छह", "छः"), ("सात",), ("आठ",), ("नौ",),
    ("दस",), ("ग्यारह",), ("बारह",), ("तेरह",), ("चौदह",), ("पंद्रह", "पन्द्रह"), ("सोलह",), ("सत्रह",), ("अठारह", "अट्ठारह"), ("उन्नीस",),
    ("बीस",), ("इक्कीस",), ("बाईस", "बाइस"), ("तेईस", "तेइस"), ("चौबीस",), ("पच्चीस",), ("छब्बीस",), ("सत्ताईस",), ("अट्ठाईस",), ("उनतीस", "उन्तीस"),
    ("तीस",), ("इकतीस",), ("बत्तीस",), ("तैंतीस", "तेतीस"), ("चौंतीस", "चौतीस"), ("पैंतीस",), ("छत्तीस",), ("सैंतीस",), ("अडतीस",), ("उनतालीस",),
    ("चालीस",), ("इकतालीस",), ("बयालीस",), ("तैंतालीस", "तैतालीस"), ("चवालीस",), ("पैंतालीस",), ("छियालीस",), ("सैंतालीस",), ("अडतालीस",), ("उनचास",),
    ("पचास",), ("इक्यावन",), ("बावन",), ("तिरेपन",), ("चौवन",), ("पचपन",), ("छप्पन",), ("सत्तावन",), ("अट्ठावन",), ("उनसठ",),
    ("साठ",), ("इकसठ",), ("बासठ",), ("तिरसठ",), ("चौंसठ", "चौसठ"), ("पैंसठ",), ("छियासठ",), (), ("अडसठ",), ("उनहत्तर",),
    ("सत्तर",), ("इकहत्तर",), ("बहत्तर",), ("तिहत्तर",), ("चौहत्तर",), ("पचहत्तर",), ("छिहत्तर",), ("सतहत्तर",), ("अठहत्तर",), ("उन्यासी",),
    ("अस्सी",), ("इक्यासी",), ("बयासी",), ("तिरासी",), ("चौरासी",), ("पचासी",), ("छियासी",), ("सत्तासी",), ("अट्ठासी",), ("नवासी",),
    ("नब्बे",), ("इक्यानवे",), ("बानवे",), ("तिरानवे",), ("चौरानवे",), ("पचानवे",), ("छियानवे",), ("सत्तानवे",), ("अट्ठानवे",), ("निन्यानवे",),
)
# Scale words (without nukta).
SCALES = (("सौ", 100), ("हजार", 1000))
# Pairs that mean "a few".
IDIOMS = (("एक", "दो"), ("दो", "चार"))
# Punctuation that may lead or trail a token.
LEADING = r"^[\(\[\{\"'“‘]+"
TRAILING = r"[\)\]\}\"'”’।,!?;:]+$"

NUMBERS = {w: n for n, spellings in enumerate(UNITS) for w in spellings} | dict(SCALES)
_LEADING, _TRAILING = re.compile(LEADING), re.compile(TRAILING)
NUKTA = "़"


def split_affixes(c: Column) -> Column:
    """struct(leading, core, trailing) of a token."""
    lead = F.regexp_extract(c, f"({LEADING})", 1)
    rest = F.substr(c, F.length(lead) + 1)
    trail = F.regexp_extract(rest, f"({TRAILING})", 1)
    return F.struct(lead.alias("leading"), F.substr(rest, F.lit(1), F.length(rest) - F.length(trail)).alias("core"), trail.alias("trailing"))


def _affixes(token: str) -> tuple[str, str, str]:
    lead = m.group() if (m := _LEADING.match(token)) else ""
    rest = token[len(lead) :]
    trail = m.group() if (m := _TRAILING.search(rest)) else ""
    return lead, rest[: len(rest) - len(trail)], trail


def fold(values: list[int]) -> int:
    """Value of a run of number words: hundreds multiply what stands before, thousands close a group, the rest adds."""
    total = group = 0
    for v in values:
        if v == 100:
            group = (group or 1) * 100
        elif v == 1000:
            total, group = total + (group or 1) * 1000, 0
        else:
            group += v
    return total + group


def fold_values(values: Column) -> Column:
    """fold() over an array column, as one aggregate."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("group"))

    def step(s: Column, v: Column) -> Column:
        some = F.when(s["group"] == 0, F.lit(1)).otherwise(s["group"])
        total = F.when(v == 1000, s["total"] + some * 1000).otherwise(s["total"])
        group = F.when(v == 100, some * 100).when(v == 1000, 0).otherwise(s["group"] + v)
        return F.struct(total.cast("long").alias("total"), group.cast("long").alias("group"))

    return F.aggregate(values, zero, step, lambda s: s["total"] + s["group"])


def number_value(c: Column) -> Column:
    """Value of a number word, else null."""
    table = F.create_map(*[F.lit(x) for p in NUMBERS.items() for x in p])
    return table[F.replace(c, F.lit(NUKTA), F.lit(""))]


def number_runs(tokens: Column) -> Column:
    """Values of each run of number words, in order, of tokens in NFKC.

    Runs end where those of spoken_to_digits() do; a number word with leading marks starts one here."""
    none = F.array().cast("array<bigint>")

    def valued(t: Column) -> Column:
        cut = split_affixes(t)
        return F.struct(number_value(cut["core"]).cast("long").alias("v"), (cut["leading"] != "").alias("lead"), (cut["trailing"] != "").alias("trail"))

    def step(s: Column, w: Column) -> Column:
        starts = w["v"].isNull() | w["lead"] | s["ended"]
        runs = F.when(starts & (F.size(s["run"]) > 0), F.concat(s["runs"], F.array(s["run"]))).otherwise(s["runs"])
        run = F.when(w["v"].isNull(), none).when(starts, F.array(w["v"])).otherwise(F.concat(s["run"], F.array(w["v"])))
        return F.struct(runs.alias("runs"), run.alias("run"), (w["v"].isNotNull() & w["trail"] & ~starts & (F.size(s["run"]) > 0)).alias("ended"))

    zero = F.struct(F.array().cast("array<array<bigint>>").alias("runs"), none.alias("run"), F.lit(False).alias("ended"))
    return F.aggregate(F.transform(tokens, valued), zero, step, lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["runs"], F.array(s["run"]))).otherwise(s["runs"]))


def spoken_to_digits(text: str) -> str:
    """The text with runs of number words as digits.

    A run ends before a word with leading marks and with a word with trailing ones, but for the first word, whose
    trailing marks don't end it. Single words for 0 to 9 and the idioms stay. A run that starts with leading marks
    on a number word stays as it is."""
    tokens = unicodedata.normalize("NFKC", text).split()
    cut = [_affixes(t) for t in tokens]
    value = [NUMBERS.get(core.replace(NUKTA, "")) for _, core, _ in cut]
    out, i = [], 0
    while i < len(tokens):
        if value[i] is None or cut[i][0]:
            out.append(tokens[i])
            i += 1
            continue
        end = i
        while end < len(tokens) and value[end] is not None:
            lead, _, trail = cut[end]
            if trail and end > i:
                end += 1
                break
            if lead and end > i:
                break
            end += 1
        run = [v for v in value[i:end]]
        first = tuple(core.replace(NUKTA, "") for _, core, _ in cut[i : i + 2])
        if (len(run) == 1 and run[0] <= 9) or (len(run) > 1 and first in IDIOMS):
            out.extend(tokens[i:end])
        else:
            out.append(f"{cut[i][0]}{fold(run)}{cut[end - 1][2]}")
        i = end
    return " ".join(out)


@F.pandas_udf(T.StringType())
def _spoken(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else spoken_to_digits(t))


def normalize_numbers(c: Column) -> Column:
    """Runs of number words as digits, spaces squeezed. Only texts beyond ASCII cross to Python."""
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    plain = F.trim(F.regexp_replace(c, r"[\s\x1C-\x1F]+", " "))
    return F.coalesce(_spoken(F.when(~ascii_only, c)), plain)
