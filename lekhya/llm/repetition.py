"""Problem 3: repetition inside one text.

Line-first cleaning: a text is cut into lines (at line breaks, after sentence ends, else every LINE_WORDS words) and
every line is judged by rules:

* punctuation: it has no word, or marks make up more than half of its characters other than white space;
* navigation: three or more entries of at most three words each, set apart by menu separators, or nothing but an
  address on the web;
* boilerplate: it says again what the text has said already. A word says something again if it lies in a second or
  later copy of a stretch of STRETCH or more words that stood earlier, or of a stretch of 1 to CYCLE words standing
  three or more times in direct succession. A line of which LINE_REPEATED of the words do is removed whole, from
  other lines just those words are removed.

A text that loses at least REJECT of its words with its lines is rejected. Removed lines can hold words that aren't
repeated, so the rejected texts of which less than REJECT is repeated are told apart (share below REJECT) by an exact
count of the repeated words.

Nulls and texts without words have loss and share 0 and are never rejected. Each batch is worked on as a whole with
numpy, a bounded number of characters at a time; time and memory are linear in the number of words however long a
text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH, CYCLE, LINE_WORDS = 6, 12, 12
#: A text that loses at least this share of its words is rejected.
REJECT = 0.4
#: A line of which at least this share is repeated fails as a whole.
LINE_REPEATED = 0.8
#: A batch is worked on in pieces of about so many characters (a longer text by itself).
PIECE = 4_000_000
_MENU = re.compile(r"\s[|»›→•·>]\s|\t")
_ADDRESS = re.compile(r"\s*(?:https?://|www\.)\S+\s*")
_PUNCT = re.compile(r"[^\w\sऀ-ॣ०-ॿ̀-ͯ‌‍]|_")
_LINE_END = re.compile(r"[\r\n]+|(?<=[.!?।॥])\s+")


def repeated_words(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words are repeated. words: codes >= 0 of all texts in a row; text: the number of each word's text."""
    n = len(words)
    marks = np.zeros(n + 1, dtype=np.int64)
    if n == 0:
        return marks[:0].astype(bool)
    if n >= STRETCH:
        # stretches of STRETCH words by their exact identity, built up by pairing codes of neighbours
        gram = words.astype(np.int64)
        for k in range(1, STRETCH):
            gram = np.unique(gram[: n - k] * (int(words.max()) + 1) + words[k:], return_inverse=True)[1]
        whole = text[: len(gram)] == text[STRETCH - 1 :]
        key = np.unique(np.where(whole, text[: len(gram)].astype(np.int64) * (int(gram.max()) + 1) + gram, -1), return_inverse=True)[1]
        first = np.full(int(key.max()) + 1, n)
        np.minimum.at(first, key, np.arange(len(key)))
        again = np.nonzero(whole & (np.arange(len(key)) - first[key] >= STRETCH))[0]
        np.add.at(marks, again, 1)
        np.add.at(marks, again + STRETCH, -1)
    for p in range(1, CYCLE + 1):
        if n < 3 * p:
            break
        same = np.zeros(n, dtype=bool)
        same[p:] = (words[p:] == words[:-p]) & (text[p:] == text[:-p])
        edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        copies = (end - start) // p
        start, copies = start[copies >= 2], copies[copies >= 2]
        np.add.at(marks, start, 1)
        np.add.at(marks, start + copies * p, -1)
    return np.cumsum(marks[:n]) > 0


def _lines(t: str) -> list[str]:
    out = []
    for line in _LINE_END.split(t):
        w = line.split()
        out.extend(" ".join(w[i : i + LINE_WORDS]) for i in range(0, len(w), LINE_WORDS))
    return out


def _is_navigation(line: str) -> bool:
    entries = [e.split() for e in _MENU.split(line)]
    return (len(entries) >= 3 and all(1 <= len(e) <= 3 for e in entries)) or _ADDRESS.fullmatch(line) is not None


def _is_marks(line: str, n_words: int) -> bool:
    shown = "".join(line.split())
    return n_words == 0 or 2 * len(_PUNCT.findall(shown)) > len(shown)


def _clean(texts: list[str | None]) -> pd.DataFrame:
    """n_words, n_repeated, n_lost, n_lines, n_failed, kept of each text."""
    all_words: list[str] = []
    text_of: list[int] = []
    lines: list[tuple[int, str, int, int]] = []  # text, line, its words from..to
    for i, t in enumerate(texts):
        for line in () if t is None else _lines(t):
            begin = len(all_words)
            all_words.extend(_PUNCT.sub("", line.lower()).split())
            text_of.extend([i] * (len(all_words) - begin))
            lines.append((i, line, begin, len(all_words)))
    words = pd.factorize(np.array(all_words, dtype=object))[0] if all_words else np.zeros(0, int)
    text = np.array(text_of, dtype=np.int64)
    again = repeated_words(words, text)
    before = np.concatenate(([0], np.cumsum(again)))
    n = len(texts)
    total, repeated, lost, n_lines, failed = (np.zeros(n, dtype=np.int64) for _ in range(5))
    held: list[list[str]] = [[] for _ in range(n)]
    for i, line, a, b in lines:
        said = int(before[b] - before[a])
        n_lines[i] += 1
        total[i] += b - a
        repeated[i] += said
        if _is_marks(line, b - a) or _is_navigation(line) or said >= LINE_REPEATED * (b - a):
            failed[i] += 1
            lost[i] += b - a
        elif said:
            lost[i] += said
            tokens = [w for w in line.split() if _PUNCT.sub("", w.lower())]
            held[i].append(" ".join(w for w, x in zip(tokens, again[a:b]) if not x) if len(tokens) == b - a else line)
        else:
            held[i].append(line)
    kept = [None if t is None else "\n".join(h) for t, h in zip(texts, held)]
    return pd.DataFrame({"n_words": total, "n_repeated": repeated, "n_lost": lost, "n_lines": n_lines, "n_failed": failed, "kept": kept})


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        size = pdf["t"].map(lambda t: len(t) if t else 0).cumsum() // PIECE
        for _, part in pdf.groupby(size, sort=False):
            out = _clean(list(part["t"]))
            out.insert(0, "id", part["id"].to_numpy())
            yield out


def measure(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, n_words, n_repeated, n_lost, share (of repeated words), loss (of words removed with lines), n_lines,
    n_failed, kept (the text without what was removed), rejected (by the loss)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInPandas(_measure, f"id {kind}, n_words long, n_repeated long, n_lost long, n_lines long, n_failed long, kept string")
    part = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0))
    out = out.select(F.col("id").alias(id_col), "n_words", "n_repeated", "n_lost", part("n_repeated").alias("share"), part("n_lost").alias("loss"), "n_lines", "n_failed", "kept")
    return out.withColumn("rejected", F.col("loss") >= REJECT)


def repetitive(measured: DataFrame) -> DataFrame:
    """The rejected texts whose repeated words alone come to REJECT."""
    return measured.where(F.col("rejected") & (F.col("share") >= REJECT))
