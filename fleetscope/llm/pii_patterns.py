"""Personal data of fixed form, found by patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of each kind; matches that fail the check of their kind are dropped.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The characters an email address may start with; see _emails.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
DIGIT = re.compile("[0-9]")
#: Numbers held together by single dots.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: Digits from which a match has the size of its kind.
LEAST_DIGITS = {"ip": 4, "card": 16, "phone": 8}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    digits = "".join(DIGIT.findall(found))
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ in linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        start = at
        while start > free and LOCAL.match(text, start - 1, start):
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the ip pattern: every four numbers of a dotted run, found in linear time."""
    for run in DOTTED.finditer(text):
        parts = run.group().split(".") if "." in run.group() else ()
        start = run.start()
        for at in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[at : at + 4])) + 3
            yield start, end
            start = end + 1


def spans_of(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern of a kind, whether they pass its check or not."""
    if kind == "email":
        return _emails(text)
    return _ips(text) if kind == "ip" else (m.span() for m in PATTERNS[kind].finditer(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for kind in KINDS[1:]:
            found += [(kind, a, b) for a, b in spans_of(kind, text) if passes(kind, text[a:b])]
    return found


def undecided(text: str) -> list[tuple[int, int]]:
    """(start, end) of matches of the size of their kind that fail its check.

    Numbers of a wrong sum look like right ones, and two entries side by side are one match
    too long, so such a stretch is an example of neither.
    """
    if not DIGIT.search(text):
        return []
    return [
        (a, b)
        for kind, least in LEAST_DIGITS.items()
        for a, b in spans_of(kind, text)
        if not passes(kind, text[a:b]) and len(DIGIT.findall(text[a:b])) >= least
    ]
