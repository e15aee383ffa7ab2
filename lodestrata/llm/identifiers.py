"""Advisory identifiers out of free spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DASHES = "‐‑‒–—―−﹘﹣－"
_INVISIBLE = "[​-‏⁠﻿­]"
_FULL_WIDTH = "".join(chr(c) for c in range(0xFF10, 0xFF5B))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B))
_SEP = r"[\s_\-:]+"
#: GHSA-style three blocks, or a family name with a first number (a year or a serial) and a second number.
IDENTIFIER = (
    r"(?<![A-Z0-9])(?:"
    rf"GHSA{_SEP}[2-9CFGHJMPQRVWX]{{4}}{_SEP}[2-9CFGHJMPQRVWX]{{4}}{_SEP}[2-9CFGHJMPQRVWX]{{4}}"
    rf"|[A-Z][A-Z0-9]{{1,15}}{_SEP}[0-9]{{3,}}{_SEP}[0-9]+"
    r")(?![A-Z0-9])"
)
#: Stand-ins that have the form of an identifier but name nothing: one repeated character in every block.
STAND_IN = r"^[A-Z0-9]+-0+-0+$|^GHSA-(.)\1{3}-\1{4}-\1{4}$"


def identifiers(text: Column) -> Column:
    """Distinct identifiers named in a text, upper case with single dashes; empty for null, blanks and stand-ins."""
    plain = F.upper(F.regexp_replace(F.translate(text, _DASHES + _FULL_WIDTH, "-" * len(_DASHES) + _ASCII), _INVISIBLE, ""))
    found = F.regexp_extract_all(plain, F.lit(IDENTIFIER), F.lit(0))
    tidy = F.transform(found, lambda x: F.regexp_replace(x, _SEP, "-"))
    return F.coalesce(F.array_distinct(F.filter(tidy, lambda x: ~x.rlike(STAND_IN))), F.array().cast("array<string>"))
