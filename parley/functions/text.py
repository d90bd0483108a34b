"""Text functions with the semantics of Python's ``str``, as JVM-side expressions."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that ``str.strip`` takes off.
WHITESPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
EXIT_WORDS = ("exit", "quit")


def strip(text: Column) -> Column:
    """``text`` without white space at both ends (``F.trim`` alone takes off spaces only)."""
    return F.trim(text, F.lit(WHITESPACE))


def is_exit(line: Column) -> Column:
    """True if the stripped line is an exit word in any case."""
    return F.lower(strip(line)).isin(*EXIT_WORDS)


def is_blank(line: Column) -> Column:
    """True for a null line, or one of white space only."""
    return F.coalesce(strip(line) == "", F.lit(True))
