"""Repetition loops in decoder output: found, measured and collapsed with back-reference patterns on tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.functions.text import normalize_spaces, words


def _line(tokens: Column) -> Column:
    """Tokens each followed by a space."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit(" "))), "")


def _loop(max_ngram: int, min_repeat: int) -> str:
    return rf"(?<!\S)((?:\S+ ){{1,{max_ngram}}})\1{{{min_repeat - 1},}}"


def _n_tokens(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def max_token_run(tokens: Column) -> Column:
    """Longest run of one token; runs are blocks of a pattern."""
    runs = F.regexp_extract_all(_line(tokens), F.lit(r"((?<!\S)(\S+ )\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, _n_tokens)), F.lit(0))


def repeat_blocks(tokens: Column, max_ngram: int = 8, min_repeat: int = 3) -> Column:
    """(block, unit) of each stretch of up to max_ngram tokens standing min_repeat or more times, longest unit first."""
    line, pattern = _line(tokens), _loop(max_ngram, min_repeat)
    return F.arrays_zip(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("block"), F.regexp_extract_all(line, F.lit(pattern), F.lit(1)).alias("unit"))


def repetition_metrics(tokens: Column, max_ngram: int = 8, min_repeat: int = 3) -> Column:
    """struct(ratio of tokens in loops, longest token run, most copies in a loop: 1 without, 0 without tokens)."""
    line, pattern = _line(tokens), _loop(max_ngram, min_repeat)
    block = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    unit = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    inside = F.aggregate(F.transform(block, _n_tokens), F.lit(0), lambda a, b: a + b)
    copies = F.array_max(F.transform(F.arrays_zip(block.alias("b"), unit.alias("u")), lambda z: (F.length(z["b"]) / F.length(z["u"])).cast("int")))
    n = F.size(tokens)
    return F.struct(
        F.when(n > 0, inside / n).otherwise(F.lit(0.0)).alias("repeated_token_ratio"),
        max_token_run(tokens).alias("max_token_run"),
        F.when(n > 0, F.coalesce(copies, F.lit(1))).otherwise(F.lit(0)).alias("max_ngram_repeat"),
    )


def collapse_loops(tokens: Column, max_ngram: int = 8, min_repeat: int = 3, keep: int = 1, max_run: int = 2) -> Column:
    """Text with loops cut down to keep copies (three passes), then token runs to max_run."""
    line, pattern = _line(tokens), _loop(max_ngram, min_repeat)
    for _ in range(3):
        line = F.regexp_replace(line, pattern, "$1" * keep)
    return F.rtrim(F.regexp_replace(line, rf"(?<!\S)(\S+ )\1{{{max_run},}}", "$1" * max_run))


def trim_tail(tokens: list[str], max_ngram: int = 4, min_repeat: int = 3) -> list[str]:
    """Tokens without a loop at the very end: of the largest unit that fits, one copy stays; until there is none."""
    changed = True
    while changed:
        changed = False
        for n in range(min(max_ngram, len(tokens) // min_repeat), 0, -1):
            unit, copies = tokens[-n:], 1
            while tokens[len(tokens) - n * (copies + 1) : len(tokens) - n * copies] == unit:
                copies += 1
            if copies >= min_repeat:
                tokens, changed = tokens[: len(tokens) - n * (copies - 1)], True
                break
    return tokens


@F.pandas_udf(T.StringType())
def _trim_tail(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else " ".join(trim_tail(t.split())))


def clean_prediction(c: Column) -> Column:
    """Normalised, loops of up to four tokens collapsed, loop at the end trimmed.

    Only texts that still end in a loop cross to Python."""
    collapsed = collapse_loops(words(normalize_spaces(c)), max_ngram=4)
    loops = F.concat(collapsed, F.lit(" ")).rlike(r"(?<!\S)((?:\S+ ){1,4})\1{2,}$")
    return F.coalesce(_trim_tail(F.when(loops, collapsed)), collapsed)
