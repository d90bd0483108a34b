"""Secrets in texts: fixed patterns, and a linear-chain conditional random field for what they miss.

A text is a chain of words and the gaps between them. Each word is tagged as the beginning of a secret, inside one or
outside, by its shape, its neighbours, the gaps around it and features of the whole text; the best chain of tags is
found by Viterbi's algorithm. A word that is outside whatever its neighbours are cuts the chain, so that the search runs
over the short stretches that are left; the result is that of the whole chain.

Nothing labels secrets, so the field learns from what the fixed patterns find in a bounded sample of texts, and from
secrets and harmless look-alikes of many forms that are written into it.

A span is ``kind:start:end`` in code points, end exclusive; a text's spans are one comma-joined string in order of
start, then of ``KINDS``.
"""

from __future__ import annotations

import pickle
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.shared import bound_batches

BASE = ("assign", "access", "hex")
#: After the base kinds, the one that the field adds.
KINDS = (*BASE, "secret")
OUT, BEGIN, INSIDE = range(3)
#: At most so many texts teach, each by a passage of so many code points with so many pieces written into it.
SAMPLE_DOCS, PASSAGE, PIECES = 300, 1600, 10
#: A feature is learned if the sample has it so many times, a piece of a word if so often of a secret or near one; what gets less weight is dropped.
LEAST_SEEN, LEAST_WEIGHT = 3, 0.05
#: Words longer than LONG aren't remembered, and have no pieces; a worker forgets its words once it has MOST_WORDS.
LONG, MOST_WORDS = 64, 200_000
#: A secret that the field adds has so many code points at least.
LEAST = 8
#: Words of a chain that are fitted together; code points and words that are taken up at once.
STRETCH, BLOCK, WORDS = 48, 1 << 18, 1 << 16

_ASSIGN = re.compile(r"(?=[apst])(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PIECE = re.compile(r"[^\W\d_]+")
_LENGTHS = (1, 2, 3, 5, 8, 12, 16, 20, 24, 32, 40, 64)
_GAPS = ("", " ", "=", ":", '"', "\n", "(", ",", "-", ".", "other")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what the fixed patterns find: leftmost, not overlapping within a kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a run of 32 or more is the same run whether or not shorter runs are matched and dropped
    return found + [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]


def _length(n: int) -> int:
    return bisect_right(_LENGTHS, n)


def _kind(word: str, runs: str) -> str:
    """What a word is made of, and how long it is."""
    size, kinds = _length(len(word)), set(runs)
    if "x" in kinds:
        return "other"
    if kinds == {"9"}:
        return f"digits{size}"
    if "9" in kinds and not word.strip(_HEX_DIGITS):
        return f"hex{size}"
    if kinds == {"a"}:
        return f"lower{size}"
    if runs == "Aa" or kinds == {"A"}:
        return f"capital{size}"
    return f"{('a' in kinds) + ('A' in kinds)}{'9' in kinds:d}{bool(kinds - _PLAIN_RUNS):d}-{size}"


_HEX_DIGITS = "0123456789abcdef"
_PLAIN_RUNS = frozenset("aA9")
_KIND_NAMES = ("other", *(f"{k}{n}" for k in ("digits", "hex", "lower", "capital", *(f"{a}{b}{c}-" for a in range(3) for b in range(2) for c in range(2))) for n in range(1, len(_LENGTHS) + 1)))
_KIND_NUMBER = {k: i for i, k in enumerate(_KIND_NAMES)}
#: What a word consists of: letters in lower and in upper case, digits, underscores, and other letters and numbers;
#: and what may stand between two of those within a word.
_LETTERS, _JOINERS = "aA9_x", "-+/.~"
_REPEAT = re.compile(r"(.)\1+", re.DOTALL)


def _letter(c: str) -> str:
    if c in string.digits:
        return "9"
    return "a" if c.islower() else "A" if c.isupper() else "x" if c.isalnum() else c


class _Letters(dict):
    """For ``str.translate``: each word's character to its kind."""

    def __missing__(self, c: int) -> str:
        self[c] = found = _letter(chr(c))
        return found


_letters = _Letters()


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """By code point: the kind (0: none, then _LETTERS, then a joiner) and, if in a gap, the gap's number; by place:
    powers for a hash of words, and their inverses."""
    kinds, gaps = np.zeros(0x110000, np.uint8), np.full(0x110000, len(_GAPS) - 1, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum() or x == "_":
            kinds[c] = 1 + _LETTERS.index(_letter(x))
    for x in _JOINERS:
        kinds[ord(x)] = 1 + len(_LETTERS)
    for i, x in enumerate(_GAPS[2:-1], 2):
        gaps[ord(x)] = i
    odd = 0x9E3779B97F4A7C15
    return kinds, gaps, *(np.cumprod(np.r_[np.uint64(1), np.full(BLOCK, p, np.uint64)]) for p in (np.uint64(odd), np.uint64(pow(odd, -1, 1 << 64))))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Where to cut a text into blocks of about BLOCK code points: after white space, so never in a word."""
    at = 0
    while at < len(text):
        stop = at + BLOCK
        if stop < len(text):
            back = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
            while back < 0 and stop < len(text):  # a word that is longer than a block
                ahead = [i for i in (text.find(" ", stop, stop + BLOCK), text.find("\n", stop, stop + BLOCK)) if i >= 0]
                back, stop = (min(ahead) if ahead else -1), stop + BLOCK
            stop = back + 1 if back >= 0 else len(text)
        yield at, min(stop, len(text))
        at = stop


def word_places(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: runs of letters, numbers and underscores, single joiners between them included."""
    inside = (kinds > 0) & (kinds <= len(_LETTERS))
    joins = kinds > len(_LETTERS)
    joins[0] = joins[-1] = False
    joins[1:] &= inside[:-1]
    joins[:-1] &= inside[1:]
    edges = np.flatnonzero(np.diff(inside | joins, prepend=False, append=False))
    return edges[::2], edges[1::2]


def _gap_number(gap: str) -> int:
    """A gap by the most telling character in it."""
    if gap == " ":
        return 1
    for i, mark in enumerate(_GAPS[2:-1], 2):
        if mark in gap:
            return i
    return 0 if not gap else len(_GAPS) - 1


#: What a word's features tell of: itself, the next word, the one after, and the one before.
_ROLES = ("own", "next", "after", "before")


@dataclass(frozen=True)
class _Word:
    kind: int
    digits: bool
    own: tuple[str, ...]
    context: tuple[str, ...]
    pieces: tuple[str, ...]

    def names(self, role: str, pieces: Iterable[str]) -> list[str]:
        """Features by their full names; a word's pieces tell nothing of the word before it."""
        parts = self.context if role == "before" else (*self.context, *pieces)
        return [f"{role}|{n}" for n in (*parts, *(self.own if role == "own" else ()))]


def _word(word: str) -> _Word:
    runs = _REPEAT.sub(r"\1", word.translate(_letters))
    kind, n = _kind(word, runs), len(word)
    context = (f"shape={runs[:6]}{'+' if len(runs) > 6 else ''}", f"kind={kind}")
    own = (f"length={_length(n)}",)
    if runs not in ("a", "A", "Aa", "x"):
        own += (f"switches={min(9, 10 * len(runs) // n)},{_length(n)}",)
        if n >= 12:
            letters = [c for c in word.lower() if c in string.ascii_lowercase]
            vowels = 10 * sum(c in "aeiou" for c in letters) // len(letters) if letters else -1
            own += (f"start={word[:4]}", f"distinct={min(8, len(set(word)) // 3)}", f"vowels={vowels}")
    pieces = tuple(f"piece={p.lower()}" for p in _PIECE.findall(word)[-3:] if len(p) <= 16) if n <= LONG else ()
    return _Word(_KIND_NUMBER[kind], "9" in runs, own, context, pieces)


def _whole_text(gaps: np.ndarray, digits: np.ndarray) -> list[str]:
    """Features of the text: how many of its gaps assign, how many hold a line's end, how many words have digits."""
    shares = (np.isin(gaps, (2, 3)).mean(), (gaps == 5).mean(), digits.mean())
    return [f"text|{i}:{bisect_right((0.01, 0.05, 0.2, 0.5), s)}" for i, s in enumerate(shares)]


def _pair(gap: int, kind: int) -> str:
    return f"pair|{_GAPS[gap]}{_KIND_NAMES[kind]}"


@dataclass(frozen=True)
class SecretModel:
    features: dict[str, int]
    weights: np.ndarray  # (feature, tag)
    moves: np.ndarray  # (tag, next tag); a text begins and ends outside

    def score(self, names: Iterable[str]) -> np.ndarray:
        """The sum of the weights of those features that were learned."""
        rows = [r for n in names if (r := self.features.get(n)) is not None]
        return self.weights[rows].sum(axis=0) if rows else np.zeros(3)

    def sure(self) -> np.ndarray:
        """By how much a tag's score may lag that of OUT and the tag still be chosen, whatever its neighbours."""
        return (self.moves - self.moves[:, [OUT]]).max(axis=0) + (self.moves - self.moves[[OUT], :]).max(axis=1)


def best_tags(scores: list[list[float]], moves: np.ndarray) -> list[int]:
    """Viterbi's algorithm over a stretch with OUT on both sides; of equal chains, smaller tags from the end."""
    t = moves.tolist()
    (a, b, c), back = t[OUT], []
    first = scores[0]  # plain floats: few words, and no arrays to make for each
    a, b, c = a + first[0], b + first[1], c + first[2]
    for e in scores[1:]:
        step, now = [], []
        for y in range(3):
            x, z, w = a + t[0][y], b + t[1][y], c + t[2][y]
            best = 0 if x >= z and x >= w else 1 if z >= w else 2
            step.append(best)
            now.append((x, z, w)[best] + e[y])
        a, b, c = now
        back.append(step)
    last = [a + t[0][OUT], b + t[1][OUT], c + t[2][OUT]]
    tags = [last.index(max(last))]
    for step in reversed(back):
        tags.append(step[tags[-1]])
    return tags[::-1]


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word of a block, for words of at most LONG code points."""
    powers, inverse = _tables()[2:]
    if len(codes) > BLOCK:
        return np.array([_hashes(codes[a:b], np.array([0]), np.array([b - a]))[0] if b - a <= LONG else np.uint64(0) for a, b in zip(starts, ends, strict=True)], np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * powers[: len(codes)])]
    return (sums[ends] - sums[starts]) * inverse[starts]


class Tagger:
    """Scores words by a model. Words of the same features are one class.

    Most words are letters alone: lower case, capitalised, upper case or without case. Those that hold no learned piece
    differ in case and length only, and those that are a learned piece are looked up by a hash; both are found for
    all words of a block at once. The classes of other words are remembered.
    """

    def __init__(self, model: SecretModel):
        self.model, self.sure = model, model.sure()
        self.pairs = np.array([[model.score([_pair(g, k)]) for k in range(len(_KIND_NAMES))] for g in range(len(_GAPS))])
        self.left, self.right = (np.array([model.score([f"{side}|{g}"]) for g in _GAPS]) for side in ("left", "right"))
        #: pieces that were learned in any role; others don't tell words apart
        self.pieces = {n.partition("|")[2] for n in model.features if "|piece=" in n}
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.classes: dict[tuple, int] = {}
        self.scores, self.kinds, self.digits = np.zeros((256, len(_ROLES), 3)), np.zeros(256, np.int64), np.zeros(256, bool)
        samples = [["a" * n, "A" + "a" * (n - 1), "A" * n, "一" * n] for n in _LENGTHS]
        self.plain = np.array([[self.classed(_word(w), False) for w in row] for row in samples])
        named = {form: self.classed(_word(form)) for p in self.pieces for x in (p.partition("=")[2],) for form in (x, x.capitalize(), x.upper())}
        hashed = sorted((int(_hashes(c, np.array([0]), np.array([len(c)]))[0]), n) for form, n in named.items() for c in (_codes(form),))
        self.named = np.array([h for h, _ in hashed] or [0], np.uint64), np.array([n for _, n in hashed] or [0], np.int64)

    def number(self, word: str) -> int:
        """The class of a word of any kind."""
        n = self.numbers.get(word)
        if n is None:
            n = self.classed(_word(word))
            if len(word) <= LONG:
                self.numbers[word] = n
        return n

    def classed(self, made: _Word, pieces: bool = True) -> int:
        key = (made.own, made.context, tuple(p for p in made.pieces if pieces and p in self.pieces))
        n = self.classes.get(key)
        if n is None:
            n = self.classes[key] = len(self.classes)
            while n >= len(self.kinds):
                self.scores, self.kinds, self.digits = (np.concatenate([a, np.zeros_like(a)]) for a in (self.scores, self.kinds, self.digits))
            self.scores[n] = [self.model.score(made.names(role, key[2])) for role in _ROLES]
            self.kinds[n], self.digits[n] = made.kind, made.digits
        return n

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and classes of all words; the numbers of the gaps before, between and after them."""
        if len(self.numbers) + len(self.classes) > MOST_WORDS:
            self.forget()
        table, in_gap = _tables()[:2]
        found = [self._block(text, at, stop, table, in_gap) for at, stop in _blocks(text)]
        starts, ends, classes, gaps = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        if not len(starts):
            return starts, ends, classes, gaps
        # gaps at the ends of blocks reach into the next one
        last = np.cumsum([len(f[0]) for f in found]) - 1
        for i in {int(i) for i in last if i >= 0}:
            gaps[i] = _gap_number(text[ends[i] : starts[i + 1] if i + 1 < len(starts) else len(text)])
        return starts, ends, classes, np.r_[_gap_number(text[: starts[0]]), gaps]

    def _block(self, text: str, at: int, stop: int, table: np.ndarray, in_gap: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, ends, classes and the gaps after the words of one block."""
        codes = _codes(text[at:stop])
        kinds = table[codes]
        starts, ends = word_places(kinds)
        if not len(starts):
            return starts, ends, starts, starts
        size = ends - starts
        # letters by kind, counted in one sum: they can't run over in words of LONG at most
        weight = np.array([0, 1, 1 << 10, 0, 0, 1 << 20, 0], np.int64)[kinds]
        sums = np.r_[0, np.cumsum(weight)]
        counts = sums[ends] - sums[starts]
        low, up, other = counts & 1023, counts >> 10 & 1023, counts >> 20
        case = np.select([low == size, (up == size) & (size > 1), (low == size - 1) & (kinds[starts] == 2), other == size], [0, 2, 1, 3], -1)
        case[size > LONG] = -1
        classes = self.plain[np.searchsorted(_LENGTHS, size, side="right") - 1, case]
        hashes, (known, numbers) = _hashes(codes, starts, ends), self.named
        near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = (known[near] == hashes) & (case >= 0)
        classes[hit] = numbers[near[hit]]
        for i in np.flatnonzero(case < 0).tolist():
            classes[i] = self.number(text[at + starts[i] : at + ends[i]])
        marks = np.r_[in_gap[codes], np.uint8(len(_GAPS) - 1)]
        gaps = np.minimum.reduceat(marks, np.stack([starts, ends], axis=1).ravel())[1::2].astype(np.int64)
        gaps[:-1][(starts[1:] - ends[:-1] == 1) & (codes[ends[:-1]] == 32)] = 1
        return starts + at, ends + at, classes, gaps

    def emissions(self, classes: np.ndarray, gaps: np.ndarray, whole: np.ndarray, at: int, stop: int) -> np.ndarray:
        """(word, tag) scores of the words from ``at`` to ``stop``."""
        scores, here = self.scores, classes[at:stop]
        e = scores[here, 0] + self.left[gaps[at:stop]] + self.right[gaps[at + 1 : stop + 1]] + self.pairs[gaps[at:stop], self.kinds[here]] + whole
        for role, back in ((1, 1), (2, 2), (3, -1)):
            near = np.arange(at, stop) - back
            in_ = (near >= 0) & (near < len(classes))
            e[in_] += scores[classes[near[in_]], role]
        return e

    def tags(self, classes: np.ndarray, gaps: np.ndarray) -> dict[int, int]:
        """The tags of the best chain that aren't OUT, by word."""
        whole = self.model.score(_whole_text(gaps, self.digits[classes]))
        places, kept = [], []
        for at in range(0, len(classes), WORDS):
            e = self.emissions(classes, gaps, whole, at, min(at + WORDS, len(classes)))
            on = np.flatnonzero(((e - e[:, [OUT]] + self.sure)[:, 1:] >= 0).any(axis=1))
            places.append(on + at)
            kept.append(e[on])
        open_, scores = np.concatenate(places), np.concatenate(kept)
        found: dict[int, int] = {}
        cuts = np.flatnonzero(np.diff(open_) > 1) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(open_)], strict=True):
            if a < b:
                found |= {int(open_[a + i]): y for i, y in enumerate(best_tags(scores[a:b].tolist(), self.model.moves)) if y}
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """What the field finds: (start, end, 3) of secrets of LEAST code points or more."""
        starts, ends, classes, gaps = self.words(text)
        if not len(starts):
            return []
        found: list[list[int]] = []
        for i, tag in self.tags(classes, gaps).items():
            if tag == INSIDE and found and found[-1][2] == i - 1:
                found[-1][1:] = int(ends[i]), i
            else:
                found.append([int(starts[i]), int(ends[i]), i])
        padded = [(a, b + len(text[b : b + 2]) - len(text[b : b + 2].lstrip("="))) for a, b, _ in found]
        return [(a, b, 3) for a, b in padded if b - a >= LEAST]


def spans_of(text: str | None, tagger: Tagger) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order. What the field finds counts where it touches no base span."""
    if not text:
        return []
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    added, i, reach = [], 0, 0
    for a, b, k in tagger.spans(text):
        while i < len(taken) and taken[i][0] < b:
            reach, i = max(reach, taken[i][1]), i + 1
        if a >= reach:
            added.append((a, b, k))
    return [(a, b, KINDS[k]) for a, b, k in sorted(base + added, key=lambda s: (s[0], s[2], s[1]))]


# --- what the field learns from

_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "private_key", "db_password", "secret_access_key", "credential", "bearer", "session_key", "signing_key", "webhook_secret", "encryption_key", "passphrase")
_PLAIN = ("name", "title", "version", "count", "status", "path", "colour", "width", "id", "commit", "parent", "revision", "build", "release", "file", "user", "language", "group", "order", "page")
_ALNUM = string.ascii_letters + string.digits

def _some(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choices(letters, k=rng.randint(low, high)))


def _uuid(rng: random.Random) -> str:
    return "-".join(_some(rng, _HEX_DIGITS, n, n) for n in (8, 4, 4, 4, 12))


def _secret_value(rng: random.Random) -> str:
    return rng.choice((
        lambda: _some(rng, _ALNUM, 16, 44),
        lambda: _some(rng, _ALNUM + "+/", 24, 44) + "=" * rng.randrange(3),
        lambda: _some(rng, _HEX_DIGITS, 16, 64),
        lambda: _some(rng, string.ascii_lowercase, 2, 4) + rng.choice("_-") + _some(rng, _ALNUM, 20, 40),
        lambda: "eyJ" + ".".join(_some(rng, _ALNUM + "_-", 16, 40) for _ in range(3)),
        lambda: _some(rng, string.ascii_uppercase + string.digits, 16, 24),
        lambda: _some(rng, string.ascii_lowercase, 4, 8) + rng.choice("!$%&#") + _some(rng, string.digits, 2, 5) + _some(rng, _ALNUM, 2, 6),
        lambda: _uuid(rng),
    ))()


def _cased(rng: random.Random, name: str) -> str:
    words = name.split("_")
    return rng.choice((name, name.upper(), "-".join(words), "".join(w.title() for w in words), f"{rng.choice(_PLAIN)}_{name}", f"{rng.choice(_PLAIN)}_{name}".upper(), " ".join(words)))


def _written(rng: random.Random) -> tuple[str, str, str]:
    """What stands before a secret, the secret, and what stands after it; or a look-alike, with an empty secret."""
    name, plain, word = _cased(rng, rng.choice(_NAMES)), _cased(rng, rng.choice(_PLAIN)), _some(rng, string.ascii_lowercase, 3, 9)
    quote = rng.choice(("", '"', "'"))
    if rng.random() < 0.5:
        before = rng.choice((f"{name} = {quote}", f"{name}: {quote}", f"{name}={quote}", f"export {name.replace(' ', '_')}={quote}", f'"{name}": "', f"Authorization: Bearer {quote}", f"my {name} is {quote}", f"the {name} is now {quote}", f"{name} -> {quote}", f"--{name} {quote}"))
        if rng.random() < 0.1:
            body = "\n".join(_some(rng, _ALNUM + "/+", 64, 64) for _ in range(rng.randint(2, 5)))
            return f"-----BEGIN {rng.choice(('RSA', 'EC'))} PRIVATE KEY-----\n", body, "\n-----END PRIVATE KEY-----\n"
        return before, _secret_value(rng), rng.choice(('"', "'", "", ";", ",", "\n")) if not quote else quote
    number = _some(rng, string.digits, 1, 12)
    alike = rng.choice((
        f"{plain} = {quote}{word}{quote}", f"{plain}: {number}", f"{plain}={_some(rng, string.digits, 1, 2)}.{_some(rng, string.digits, 1, 2)}.{_some(rng, string.digits, 1, 2)}", f"{plain} {_uuid(rng)}",
        f"commit {_some(rng, _HEX_DIGITS, 7, 12)}", f"{name} is required", f"{name} count = {number}", f"the {name} of the {word}", f"{name} = None", f"{name}: str", f"{name} = {word}({quote}{word}{quote})",
        f"https://{word}.example.com/{word}/{number}", f"/usr/{word}/{word}.{word}", "".join(w.title() for w in (word, plain, word)) + "Factory", f"{word}.{word}_{word}({number})", f"{plain}: 20{number[:2]:0>2}-11-{number[-2:]:0>2}T10:00:00",
        f"{_some(rng, string.digits, 9, 19)}", f"{word}{number[:3]}", f"{name} expired", f"{name}: {word}", f"+{number} {number[:3]}", f"{word}@{word}.example.com", f"{plain} {_some(rng, string.ascii_uppercase, 2, 5)}-{number}", f"{word}-{word}-{word}-{word}",
    ))
    return alike, "", ""


def written_into(text: str, rng: random.Random, pieces: int) -> tuple[str, list[tuple[int, int]]]:
    """``text`` with secrets and look-alikes between its words; where the secrets are, base spans' values too."""
    cuts = sorted(rng.sample([m.end() for m in re.finditer(r"\s+", text)] or [len(text)], k=min(pieces, max(1, text.count(" ")))))
    out, spans, at, size = [], [], 0, 0
    for cut in cuts:
        before, secret, after = _written(rng)
        head = text[at:cut] + before
        spans += [(size + len(head), size + len(head) + len(secret))] * bool(secret)
        out += [head, secret, after + rng.choice((" ", "\n", ". "))]
        at, size = cut, size + len(head) + len(secret) + len(out[-1])
    new = "".join(out) + text[at:]
    found = [m.span(2) for m in _ASSIGN.finditer(new) if m.end(2) - m.start(2) >= 8 and re.search("[0-9]", m[2])]
    return new, spans + found + [(a, b) for a, b, k in base_spans(new) if k]


def _lessons(texts: list[str], seed: int) -> Iterator[tuple[list[list[str]], list[int]]]:
    """(features of each word, tags) of each text, with secrets and look-alikes written into it."""
    rng, words = random.Random(seed), {}
    for text in texts:
        new, spans = written_into(text, rng, PIECES)
        starts, ends = word_places(_tables()[0][_codes(new)])
        if not len(starts):
            continue
        made = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if (w := new[a:b]) not in words:
                words[w] = {r: _word(w).names(r, _word(w).pieces) for r in _ROLES} | {"made": _word(w)}
            made.append(words[w])
        gaps = [_gap_number(new[a:b]) for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(new)], strict=True)]
        whole = _whole_text(np.array(gaps), np.array([m["made"].digits for m in made]))
        features = []
        for i, m in enumerate(made):
            row = [*m["own"], f"left|{_GAPS[gaps[i]]}", f"right|{_GAPS[gaps[i + 1]]}", _pair(gaps[i], m["made"].kind), *whole]
            row += made[i - 1]["next"] if i else ()
            row += made[i - 2]["after"] if i > 1 else ()
            row += made[i + 1]["before"] if i + 1 < len(made) else ()
            features.append(row)
        tags = np.zeros(len(made), np.int64)
        for a, b in spans:
            inside = np.flatnonzero((starts < b) & (ends > a))
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
        yield features, tags.tolist()


def fit_field(texts: list[str], steps: int = 70, rate: float = 0.15, penalty: float = 1e-5, seed: int = 17) -> SecretModel:
    """Maximum likelihood of the tags of all stretches, by Adam's method on all of them at once."""
    lessons = list(_lessons(texts, seed))
    seen = Counter(n for names, tags in lessons for row, y in zip(names, tags, strict=True) for n in row if y or "|piece=" not in n)
    number = {n: i for i, n in enumerate(n for n, c in seen.items() if c >= LEAST_SEEN)}
    stretches: list[tuple[list[list[int]], list[int]]] = []
    for names, tags in lessons:
        features = [[number[n] for n in row if n in number] for row in names]
        at = 0
        while at < len(tags):
            stop = min(len(tags), at + STRETCH)
            while stop < len(tags) and tags[stop - 1] != OUT and stop > at + STRETCH // 2:  # no cut within a secret
                stop -= 1
            stretches.append((features[at:stop], tags[at:stop]))
            at = stop
    rows, long = len(stretches), STRETCH
    mask, gold = np.zeros((rows, long), bool), np.zeros((rows, long), np.int64)
    for i, (_, tags) in enumerate(stretches):
        mask[i, : len(tags)], gold[i, : len(tags)] = True, tags
    flat = [np.array(f) for features, _ in stretches for f in features]
    sizes, at = np.array([len(f) for f in flat]), np.concatenate(flat)
    begins, word = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(sizes)), sizes)
    truth = np.eye(3)[gold] * mask[..., None]
    before, after = np.concatenate([np.zeros((rows, 1), np.int64), gold[:, :-1]], 1), gold
    count = np.zeros((3, 3))
    np.add.at(count, (before[mask], after[mask]), 1)
    ends = mask.sum(axis=1)
    np.add.at(count, (gold[np.arange(rows), ends - 1], np.zeros(rows, np.int64)), 1)
    total = mask.sum()
    params = [np.zeros((len(number), 3)), np.zeros((3, 3))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        weights, moves = params
        e = np.zeros((rows, long, 3))
        e[mask] = np.add.reduceat(weights[at], begins, axis=0)
        forward, backward = np.zeros((rows, long, 3)), np.zeros((rows, long, 3))
        forward[:, 0] = moves[OUT] + e[:, 0]
        for t in range(1, long):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        norm = np.logaddexp.reduce(forward[:, -1] + moves[:, OUT], axis=1)
        backward[:, -1] = moves[:, OUT]
        expected = np.zeros((3, 3))
        for t in range(long - 2, -1, -1):
            go = moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
            on = mask[:, t + 1]
            backward[:, t] = np.where(on[:, None], np.logaddexp.reduce(go, axis=2), moves[:, OUT])
            expected += np.exp(forward[on, t, :, None] + go[on] - norm[on, None, None]).sum(axis=0)
        share = np.exp(forward + backward - norm[:, None, None]) * mask[..., None]
        expected[OUT] += share[:, 0].sum(axis=0)
        expected[:, OUT] += share[np.arange(rows), ends - 1].sum(axis=0)
        back = (share - truth)[mask]
        pull = np.stack([np.bincount(at, back[word, y], len(number)) for y in range(3)], axis=1)
        for i, g in enumerate((pull / total + penalty * weights, (expected - count) / total + penalty * moves)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    heavy = [(n, i) for n, i in number.items() if np.abs(params[0][i]).max() >= LEAST_WEIGHT]
    return SecretModel({n: i for i, (n, _) in enumerate(heavy)}, params[0][[i for _, i in heavy]].reshape(-1, 3), params[1])


def train_secrets(docs: DataFrame, seed: int = 17, sample: int = SAMPLE_DOCS) -> SecretModel:
    """A field from a passage each of at most ``sample`` different texts, those with the smallest hashes.

    Null and empty texts teach nothing. Without texts the field learns from what is written into plain filler alone.
    One task fits the sample; only the model, of fixed size, comes to the driver.
    """
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    place = F.xxhash64(text, F.lit(seed))
    known = docs.where(F.length(text) > 0).select(place.alias("place"), F.substring(text, (F.pmod(place, F.greatest(F.lit(1), F.length(text) - PASSAGE + 1)) + 1).cast("int"), F.lit(PASSAGE)).alias("passage"))
    n = docs.count()
    near = known.where((F.col("place") / 2.0**64 + 0.5) * n < 4.0 * sample + 100).groupBy("place").agg(F.min("passage").alias("passage"))
    few = near.orderBy("place").limit(sample).unionByName(docs.sparkSession.createDataFrame([(0, "plain words of filler text . " * 8)] * 40, near.schema))
    found = few.repartition(1).sortWithinPartitions("place", "passage").mapInArrow(lambda it: _fit_batches(it, seed), "model binary").first()
    return pickle.loads(found["model"])


def _fit_batches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    model = fit_field([text for batch in batches for text in batch["passage"].to_pylist()], seed=seed)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def find_secrets(spark: SparkSession, docs: DataFrame, model: SecretModel, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` with the column ``out``: all spans of each whole text, as one string.

    Null and empty texts have no spans (an empty string). Rows are independent, so repeated rows get equal results and
    other columns are untouched; a column named ``out`` is replaced. Nothing is shuffled; the model's size is fixed.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(StringType())
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(shared.value)
        for texts in batches:
            yield texts.map(lambda t: ",".join(f"{k}:{a}:{b}" for a, b, k in spans_of(t, tagger)))

    return docs.withColumn(out, spans(F.coalesce(F.col(text).cast("string"), F.lit(""))))
