"""Personal data by anchor expansion.

One Aho-Corasick pass over each lowered text finds anchors: at-signs, plus signs, digits, schemes and identifier cues.
Local parsers expand an anchor to a span and validate it. A span is ``kind:start:end`` in code points, end
exclusive; a text's spans are one comma-joined string in order of start, then of ``KINDS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.shared import bound_batches

BASE = ("email", "ip", "card", "phone")
#: After the base kinds, those the anchors add.
KINDS = (*BASE, "url", "iban", "account")
CUES = ("account", "acct", "iban", "passport", "customer id", "user id", "client id", "api key", "access key", "token", "secret", "password")
#: What may stand between the words of a cue.
JOINERS = (" ", "_", "-", "")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IN_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_AUTHORITY = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_VALUE = re.compile(r"(?:[\s_-]?(?:no\.?|number|nr\.?|#))?(?:\sis\b)?\s{0,2}[:=#]?\s{0,2}[\"']?([A-Za-z0-9][A-Za-z0-9_./+-]{4,})", re.I)


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    for mark, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(mark, (kind, len(mark)))
    for cue in CUES:
        for joiner in JOINERS:
            spelling = cue.replace(" ", joiner)
            found.add_word(spelling, ("cue", len(spelling)))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """The text in lower case, with as many code points: those whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    rest = digits.lstrip("0")
    return len(rest) < 3 or len(rest) == 3 and rest <= "255"


def _iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, at: int) -> int:
    """Where the longest IBAN that starts at ``at`` and passes its check ends; 0 if none does.

    Ends between words are tried first, so that part of a next word isn't taken by chance.
    """
    m = _IBAN.match(text, at)
    if not m:
        return 0
    ends, n = [], 0
    for i in range(at, m.end()):
        n += text[i] != " "
        if n >= 15 and text[i] != " ":
            ends.append(i + 1)
    whole = [e for e in ends if not text[e : e + 1].isalnum()]
    return next((e for e in (*reversed(whole), *reversed(ends)) if _iban_holds(text[at:e])), 0)


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order. The base kinds are leftmost and don't overlap within a kind; a match that
    fails its check is dropped and its text is not tried again for that kind."""
    if not text:
        return []
    spans: list[tuple[int, int, int]] = []
    end = dict.fromkeys(("email", "ip", "card", "phone", "url", "account"), 0)
    for last, (kind, n) in _anchors().iter(_lowered(text)):
        at = last - n + 1
        if kind == "digit":
            if at >= end["card"]:
                if m := _CARD.match(text, at):
                    end["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        spans.append((at, m.end(), 2))
                else:
                    end["card"] = at + 1
            if at >= end["ip"]:
                if m := _IP.match(text, at):
                    end["ip"] = m.end()
                    if all(map(_octet, m[0].split("."))):
                        spans.append((at, m.end(), 1))
                else:  # no later digit of this run starts a match either
                    end["ip"] = _DIGITS.match(text, at).end()
        elif kind == "at":
            lo = at
            while lo > end["email"] and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at and (m := _DOMAIN.match(text, at + 1)):
                end["email"] = m.end()
                spans.append((lo, m.end(), 0))
        elif kind == "plus":
            if m := _PHONE.match(text, at):
                end["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((at, m.end(), 3))
        elif kind == "scheme":
            lo = at
            while lo > end["url"] and text[lo - 1] in _IN_SCHEME:
                lo -= 1
            # what follows is read only if a scheme leads it, and then it is no other URL's: so it's read once
            m = _SCHEME.search(text, lo, at)
            if m and (tail := _AUTHORITY.match(text, at + 3)):
                stop = tail.end()
                while stop > at + 3 and text[stop - 1] in ".,;:!?)":
                    stop -= 1
                if stop > at + 3:
                    spans.append((m.start(), stop, 4))
                    end["url"] = stop
        elif at >= end["account"] and not (at and text[at - 1].isalnum()):
            if m := re.compile(r"[\s:=#]{0,4}").match(text, last + 1):
                if stop := _iban_end(text, m.end()):
                    spans.append((m.end(), stop, 5))
                    end["account"] = stop
                elif (v := _VALUE.match(text, last + 1)) and any(c.isdigit() for c in v[1]):
                    stop = v.end(1)
                    while text[stop - 1] in "./+-":
                        stop -= 1
                    spans.append((v.start(1), stop, 6))
                    end["account"] = stop
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))]


def redacted(text: str | None) -> str | None:
    """The text with each span (spans that overlap: their union) replaced by ``<KIND>``; again, until none is left."""
    while found := spans_of(text):
        out, at, i = [], 0, 0
        while i < len(found):
            start, end, kind = found[i]
            while i + 1 < len(found) and found[i + 1][0] < end:
                i += 1
                end = max(end, found[i][1])
            out += [text[at:start], f"<{kind.upper()}>"]
            at, i = end, i + 1
        text = "".join(out) + text[at:]
    return text


@F.pandas_udf(StringType())
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: ",".join(f"{k}:{a}:{b}" for a, b, k in spans_of(t)))


@F.pandas_udf(StringType())
def _redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(redacted)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with the column ``out``: all spans of each whole text, as one string.

    Null and empty texts have no spans (an empty string). Rows are independent, so repeated rows get equal
    results and other columns are untouched; a column named ``out`` is replaced. Nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, _spans(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; null stays null."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(text, _redact(F.col(text).cast("string")))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    """The array of those spans of a span string that are of ``kinds``."""
    return F.filter(F.split(spans, ","), lambda s: F.substring_index(s, ":", 1).isin(*kinds))
