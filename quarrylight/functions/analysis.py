"""Column expressions that turn text into index terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space as the C locale has it. Java's and RE2's ``\s`` differ in the vertical tab, so it is spelt out.
SPACE = r"[ \t\n\x0B\f\r]+"


def clean_term(token: Column) -> Column:
    """Keeps ASCII letters and digits, then lower-cases. Stripping comes first, since some other letters lower to ASCII."""
    return F.when(token.rlike("[^a-z0-9]"), F.lower(F.regexp_replace(token, "[^A-Za-z0-9]", ""))).otherwise(token)


def terms(text: Column) -> Column:
    """The array of index terms of a text, in order. A null text gives an empty array.

    Characters are deleted from the whole text at once, which equals cleaning token by token.
    """
    kept = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9 \t\n\x0B\f\r]+", ""))
    return F.array_remove(F.split(kept, SPACE), "")


_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_LOWERED, _DELETED = bytes.maketrans(_UPPER, _LOWER), bytes(set(range(256)) - set(_UPPER + _LOWER + b"0123456789 \t\n\x0b\f\r"))


def tokens(text: bytes) -> list[bytes]:
    """What ``terms`` gives, for a text in UTF-8 that is in a Python worker. Bytes split at ASCII white space."""
    return text.translate(_LOWERED, _DELETED).split()


def vb_len(n: Column) -> Column:
    """Bytes of a non-negative integer in groups of seven bits."""
    out = F.lit(9)
    for groups in range(8, 0, -1):
        out = F.when(n < F.lit(1 << (7 * groups)), groups).otherwise(out)
    return out.cast("bigint")
