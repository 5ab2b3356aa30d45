"""Noise tests: symbol-only messages, laughter, repetition, emoji counts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from murmullo.functions.text import clean_text_unicode, text_or_empty

# Emoji blocks, laughter runs and repetition patterns.
EMOJI_CLASS = "[\U0001F300-\U0001FAFF\u2600-\u27BF]"
LAUGHTER = ("ja" * 5, "xd" * 4)
LAUGHTER_WITH_Z = (*LAUGHTER, "zzz" * 3)
REPEATED_CHARACTER = r"(.)\1{5,}"
REPEATED_WORD = r"\b(\w+)(?:\s+\1){2,}\b"


def is_symbol_only(raw: Column) -> Column:
    """Non-blank text with nothing but emoji, blanks and non-word characters (ASCII notion of word)."""
    text = text_or_empty(raw)
    return (F.length(F.trim(text)) > 0) & ~text.rlike(r"[a-zA-Z0-9]")


def is_symbol_only_unicode(raw: Column, normalized: Column) -> Column:
    """Unicode notion of word; blank texts and texts of only ``:shortcode:`` tokens count too."""
    text = F.regexp_replace(text_or_empty(raw), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    only_shortcodes = text.rlike(r"(?U)^:[^\s\x1c-\x1f]+:([\s\x1c-\x1f]+:[^\s\x1c-\x1f]+:)*$")
    rest = F.regexp_replace(text, "(?U)" + EMOJI_CLASS + r"|[\s\x1c-\x1f]", "")
    bare = (F.length(rest) > 0) & ~rest.rlike(r"[\p{L}\p{N}]")
    bare_normal = (F.length(normalized) > 0) & ~normalized.rlike(r"[a-z0-9]")
    return (F.length(text) == 0) | only_shortcodes | bare | bare_normal


def is_laughter(normalized: Column, with_z: bool = True) -> Column:
    """The shortest runs that count, in either case: plain searches, several times faster than a case-blind pattern."""
    found = [F.contains(F.lower(normalized), F.lit(run)) for run in (LAUGHTER_WITH_Z if with_z else LAUGHTER)]
    return reduce(or_, found)


def has_repetition(raw: Column, normalized: Column) -> Column:
    """One character six times in a row, one word three times in a row, or four or more equal words."""
    tokens = F.split(normalized, " ")
    return (
        # the text is lower case already; Java's case-blind back-reference fails on emoji
        clean_text_unicode(raw).rlike(REPEATED_CHARACTER)
        | normalized.rlike(REPEATED_WORD)
        | ((F.size(tokens) >= 4) & (F.size(F.array_distinct(tokens)) == 1))
    )


def emoji_count(raw: Column) -> Column:
    return F.regexp_count(text_or_empty(raw), F.lit(EMOJI_CLASS)).cast("int")


def is_emoji_only(raw: Column) -> Column:
    """At least one emoji and nothing else but blanks."""
    text = text_or_empty(raw)
    rest = F.regexp_replace(text, EMOJI_CLASS + r"|\s", "")
    return (emoji_count(raw) > 0) & (F.length(rest) == 0)


def is_single_emoji(raw: Column) -> Column:
    return (emoji_count(raw) == 1) & is_emoji_only(raw)
