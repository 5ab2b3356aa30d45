"""Text cleaning and normalisation as built-in Column expressions.

Each chain is kept to the fewest regex passes that give the documented result:
the regex passes dominate the cost of a text scan.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# URL pattern, accent folding pairs, invisible characters.
URL_PATTERN = r"https?://\S+|www\.\S+"
ACCENTED, FOLDED = "áéíóúüñ", "aeiouun"
INVISIBLE = "\u200b\ufeff"

# Java's \s is ASCII; this class also covers what Python calls white space.
_UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"
_UNICODE_URL = r"(?iU)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
_BLANKS = "".join(chr(code) for code in range(33))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def without_urls(lowered: Column) -> Column:
    """A blank for every URL of a lower-case text; a text without either beginning of a URL is not searched for the pattern."""
    held = F.contains(lowered, F.lit("://")) | F.contains(lowered, F.lit("www."))
    return F.when(held, F.regexp_replace(lowered, URL_PATTERN, " ")).otherwise(lowered)


def without_accents(lowered: Column) -> Column:
    """ACCENTED letters as FOLDED ones: a search for each letter is faster than ``translate``, which looks up every character."""
    for accented, folded in zip(ACCENTED, FOLDED):
        lowered = F.replace(lowered, F.lit(accented), F.lit(folded))
    return lowered


def clean_text(col: Column) -> Column:
    """Lower case, URLs removed, every white-space run one blank, trimmed; null becomes ''."""
    no_urls = without_urls(F.lower(text_or_empty(col)))
    return F.trim(F.regexp_replace(no_urls, r"\s++", " "))


def clean_text_unicode(col: Column) -> Column:
    """As :func:`clean_text`, with Unicode white space, invisible characters and any-case URLs."""
    visible = F.translate(text_or_empty(col), INVISIBLE, " " * len(INVISIBLE))
    no_urls = F.regexp_replace(visible, _UNICODE_URL, " ")
    return F.lower(F.trim(F.regexp_replace(no_urls, _UNICODE_SPACE, " ")))


def clean_lake_text(col: Column) -> Column:
    """Cleaning at ingest: invisible characters and white-space runs to one blank; case kept."""
    visible = F.translate(text_or_empty(col), INVISIBLE, " " * len(INVISIBLE))
    return F.trim(F.regexp_replace(visible, _UNICODE_SPACE, " "))


@lru_cache(maxsize=1)
def _mark_folding() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter or digit plus marks, and that base."""
    source, target = [], []
    for code in range(0x80, 0x30000):
        char = chr(code)
        decomposed = unicodedata.normalize("NFD", char)
        if decomposed == char:
            continue
        base = "".join(c for c in decomposed if unicodedata.category(c) != "Mn").lower()
        if len(base) == 1 and base.isascii() and (base.isalnum() or base in ":_"):
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def fold_marks(col: Column) -> Column:
    """Accents and other combining marks removed, also from precomposed letters."""
    return F.translate(F.regexp_replace(col, r"\p{Mn}+", ""), *_mark_folding())


def norm_text(col: Column, squeeze: str | None = "vowels") -> Column:
    """Normal form used for term matching: only ``[a-z0-9:_]`` words, one blank apart.

    squeeze='vowels'  runs of three or more of one vowel shrink to one
    squeeze=None      runs are kept
    squeeze='any'     runs of any character shrink, and all combining marks are folded
    """
    if squeeze == "any":
        folded = F.regexp_replace(fold_marks(clean_text_unicode(col)), r"(.)\1{2,}", "$1")
    else:
        folded = without_accents(without_urls(F.lower(text_or_empty(col))))
        if squeeze == "vowels":
            folded = F.regexp_replace(folded, r"([aeiou])\1{2,}+", "$1")
    # the text is lower case, so \w means [a-z0-9_] here; Java runs this class several times faster
    # than the same set spelled out; no run is given back, so they are possessive
    return F.trim(F.regexp_replace(folded, r"[^\w:]++", " "))


def norm_stream(col: Column) -> Column:
    """Streaming normal form: lower case, white space collapsed, accents kept."""
    return F.btrim(F.regexp_replace(F.lower(text_or_empty(col)), r"\s+", " "), F.lit(_BLANKS))


def non_empty(col: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(col.cast("string"), F.lit(""))


def main_text(clean: Column, raw: Column, empty_is_missing: bool = True) -> Column:
    """The text to analyse: the clean message, else the raw one, else ''."""
    if empty_is_missing:
        clean, raw = non_empty(clean), non_empty(raw)
    return F.coalesce(clean, raw, F.lit(""))


def first_text(*cols: Column) -> Column:
    """First candidate that is neither null nor empty, else ''."""
    return F.coalesce(*[non_empty(c) for c in cols], F.lit(""))


def json_string(value: Column, key: str) -> Column:
    """Top-level string field of a JSON text; '' when absent or not a string.

    Line breaks and tabs inside the value become blanks.
    """
    field = F.try_variant_get(F.try_parse_json(value), f"$.{key}", "variant")
    text = F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))
    return F.coalesce(F.translate(text, "\n\r\t", "   "), F.lit(""))


def message_length(col: Column, units: str = "code_points") -> Column:
    """Length in code points, or in UTF-16 units as a JVM stream job counts them."""
    text = text_or_empty(col)
    if units == "utf16":
        return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    return F.length(text)


def is_empty(col: Column) -> Column:
    return F.length(text_or_empty(col)) == 0


# Up to so many substrings, a search for each is faster than one pattern for all.
FEW_SUBSTRINGS = 24


def _tree(terms) -> dict:
    """Terms by their characters; the empty key marks the end of a term."""
    tree: dict = {}
    for term in terms:
        node = tree
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}
    return tree


def _written(node: dict, shortest: bool) -> str:
    """A pattern of a tree: a common beginning is written, and later tried, once."""
    if "" in node and (shortest or len(node) == 1):
        return ""
    below = {c: _written(n, shortest) for c, n in sorted(node.items()) if c}
    single = [c for c, rest in below.items() if not rest]
    branches = [_escaped(c) + rest for c, rest in below.items() if rest]
    if single:
        branches.append(_escaped(single[0]) if len(single) == 1 else "[" + "".join(map(_escaped, single)) + "]")
    return (branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")") + ("?" if "" in node else "")


def any_pattern(terms) -> str:
    """One pattern that is found wherever any of the terms is."""
    return _written(_tree(terms), shortest=True)


def whole_pattern(terms) -> str:
    """One pattern of exactly the given terms; of two that begin alike it prefers the longer."""
    return _written(_tree(terms), shortest=False)


def _escaped(char: str) -> str:
    return char if char.isalnum() or char in " _" else "\\" + char


def contains_any(col: Column, terms) -> Column:
    """Whether the normalised text has any term as a substring.

    Terms are normalised as the text is, so blanks around a term are lost.
    """
    needles = list(dict.fromkeys(" ".join(term.lower().split()) for term in terms))
    if len(needles) > FEW_SUBSTRINGS:
        return col.rlike(any_pattern(needles))
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(col, F.lit(needle))
    return found


def truncate(col: Column, limit: int, newline: str = " ", pipe: str = "/") -> Column:
    """One-line preview: line breaks and pipes replaced, cut with '...' beyond the limit."""
    flat = F.replace(F.replace(text_or_empty(col), F.lit("\n"), F.lit(newline)), F.lit("|"), F.lit(pipe))
    return F.when(
        F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))
    ).otherwise(flat)
