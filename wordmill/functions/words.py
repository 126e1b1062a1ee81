"""Tokenising and normalising words: pure ``Column`` → ``Column`` functions.

Letters are ASCII A-Z and a-z; every other byte is not a letter. A word without a letter
is kept as it is, so ``1997`` and ``***`` count as words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(line: Column) -> Column:
    """Array of a line's pieces between single spaces; runs of spaces leave empty pieces.

    Tabs, carriage returns and punctuation don't split.
    """
    return F.split(line, " ", -1)


def ascii_lower(token: Column) -> Column:
    """Only A-Z change (``lower`` would change other letters too)."""
    return F.translate(token, _UPPER, _LOWER)


def byte_view(text: Column) -> Column:
    """Each byte as one character, so that lengths, cuts and patterns work on bytes."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def from_byte_view(text: Column) -> Column:
    """The bytes behind a byte view; they may not be valid UTF-8."""
    return F.encode(text, "ISO-8859-1")


def normalize(token: Column, strip: str = "all") -> Column:
    """Lower-case a token and strip non-letters from its ends.

    "all": until a letter stands at each end. "once": at most one from each end; that
    takes one byte, so give it a byte view where the text may not be ASCII.
    """
    low = ascii_lower(token)
    if strip == "all":
        bare = F.regexp_replace(low, r"\A[^a-z]+|[^a-z]+\z", "")
    elif strip == "once":
        bare = F.regexp_replace(F.regexp_replace(low, r"\A[^a-z]", ""), r"[^a-z]\z", "")
    else:
        raise ValueError(f"strip must be all or once, not {strip!r}")
    return F.when(low.rlike("[a-z]"), bare).otherwise(low)


def fits(token: Column, word: Column, max_bytes: int) -> Column:
    """Whether a word is short enough, in bytes. Normalising never lengthens, so the
    word's own length matters only where the token is too long."""
    return (F.octet_length(token) <= max_bytes) | (F.octet_length(word) <= max_bytes)


def count_row(word: Column, cnt: Column) -> Column:
    """``word count``, the row of every text output."""
    return F.concat_ws(" ", word, cnt.cast("string"))
