"""Line-first cleaning: judge lines, drop those that fail, then judge what is left.

A line with a word fails if one of these holds (all counts are of the line):

- boilerplate: its lower-case text holds one of PHRASES;
- navigation: it has at least 3 separators | and they are over a quarter of its words, or it
  has at least 3 words and all but the last end in one of > and |;
- punctuation: its symbols #*$%&|<> are over a fifth as many as its words (3 at least), or over
  half of its words (3 at least) end in two exclamation or question marks, or it has 8 or more
  words and no sentence mark or comma at all, or a word is repeated 5 times in a row.

A document is kept if it passes the base rules and the lines that stay hold at least the
share min_kept of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from fleetscope.llm.common import map_rows

#: Lower-case text that marks a line as boilerplate.
PHRASES = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "lorem ipsum",
    "javascript is disabled",
    "skip to content",
    "licensed under",
    "is licensed under",
    "sign up for our newsletter",
)
BOILERPLATE = re.compile("|".join(map(re.escape, PHRASES)))
SYMBOLS = re.compile(r"[#*$%&|<>]")
MARKS = re.compile(r"[.,;:!?。！？、，]")
SHOUT = (b"!!", b"??")


def line_fails(line: str, words: list[bytes]) -> bool:
    n = len(words)
    if BOILERPLATE.search(line.lower()):
        return True
    symbols = len(SYMBOLS.findall(line))
    bars = words.count(b"|")
    if bars >= 3 and 4 * bars > n:
        return True
    if n >= 3 and symbols and all(w.endswith((b">", b"|")) for w in words[:-1]):
        return True
    if symbols >= 3 and 5 * symbols > n:
        return True
    if n >= 3 and 2 * sum(w.endswith(SHOUT) for w in words) > n:
        return True
    if n >= 8 and not MARKS.search(line):
        return True
    run = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        if run >= 5:
            return True
    return False


def repeat_words(words: list[bytes]) -> int:
    """Words within 3-word windows that are found twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    two = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    inverse, counts = np.unique(two[:-1] * np.int64(n) + two[1:], return_inverse=True, return_counts=True)[1:]
    again = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: str | None, min_words: int = 50, max_repeat: int = 50, min_kept: float = 0.5) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_failed_lines, n_kept_words, cleaned text) of one text; null counts as empty."""
    text = text or ""
    total, word_chars, dups, failed, kept_words = 0, 0, 0, 0, 0
    seen: set[str] = set()
    words: list[bytes] = []
    stays: list[str] = []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            stays.append(line)
            continue
        dups += line in seen
        seen.add(line)
        words += own
        total += len(own)
        word_chars += _chars(line)
        if line_fails(line, own):
            failed += 1
        else:
            kept_words += len(own)
            stays.append(line)
    symbols = len(SYMBOLS.findall(text))
    repeats = repeat_words(words)
    base_failed = total < min_words or 100 * repeats > max_repeat * total
    kept = not base_failed and kept_words >= min_kept * total
    return total, word_chars, symbols, dups, repeats, base_failed, kept, failed, kept_words, "\n".join(stays)


def _chars(line: str) -> int:
    """Code points of words; only these six characters separate words."""
    return len(line) - sum(line.count(c) for c in " \t\n\r\x0b\x0c")


def _measured(rows: Iterable[tuple], with_text: bool, **limits) -> Iterator[tuple]:
    for doc_id, text in rows:
        found = measure(text, **limits)
        yield (doc_id, *(found if with_text else found[:-1]))


def clean_lines(
    docs: DataFrame, min_words: int = 50, max_repeat: int = 50, min_kept: float = 0.5, with_text: bool = True
) -> DataFrame:
    """One row for each row of docs: doc_id, counts, verdict and (with_text) the cleaned text.

    Null and empty texts count as texts without words and fail the base rules. Repeated
    rows are judged one by one; columns other than doc_id and text are not read.
    """
    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, n_failed_lines bigint, n_kept_words bigint"
    )
    limits = {"min_words": min_words, "max_repeat": max_repeat, "min_kept": min_kept}
    return map_rows(
        docs.select("doc_id", "text"),
        partial(_measured, with_text=with_text, **limits),
        schema + (", cleaned string" if with_text else ""),
    )
