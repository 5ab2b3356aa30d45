"""Political actors: resolution from text and canonical keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from murmullo.functions.text import contains_any, text_or_empty

# Actor keys in order of precedence with their substrings.
ACTOR_TERMS: Mapping[str, Sequence[str]] = {
    "keiko_fujimori_fp": ("keiko", "fujimori", "fuerza popular", " fp "),
    "castillo_peru_libre": ("castillo", "peru libre", "perú libre"),
    "jp_juntos_por_el_peru": ("jp", "juntos por el peru", "juntos por el perú"),
    "lopez_aliaga_porky": ("lopez aliaga", "lópez aliaga", "porky", "rla"),
    "antauro": ("antauro",),
    "onpe_jne": ("onpe", "jne"),
}

# Alias patterns of canonical keys, first match wins.
ACTOR_ALIASES: Mapping[str, str] = {
    "keiko_fujimori_fp": "keiko|fujimori",
    "onpe_jne": "onpe|jne",
    "castillo_peru_libre": "castillo|peru libre",
    "jp_juntos_por_el_peru": "juntos|^jp$|jp_",
    "lopez_aliaga_porky": "porky|aliaga|rla",
    "antauro_humala": "antauro",
}


def _first_match(cases, otherwise: Column) -> Column:
    result = otherwise
    for key, condition in reversed(list(cases)):
        result = F.when(condition, key).otherwise(result)
    return result


def resolve_actor(stream_text: Column, actors: Mapping[str, Sequence[str]] = ACTOR_TERMS) -> Column:
    """Key of the first actor group with a substring in the (stream-normalised) text, else ''."""
    return _first_match(((key, contains_any(stream_text, terms)) for key, terms in actors.items()), F.lit(""))


def canonical_actor(alias: Column, aliases: Mapping[str, str] = ACTOR_ALIASES) -> Column:
    """Canonical key of an alias; unknown aliases become lower case with '_' for white space."""
    name = F.lower(text_or_empty(alias))
    fallback = F.regexp_replace(name, r"\s+", "_")
    return _first_match(((key, name.rlike(pattern)) for key, pattern in aliases.items()), fallback)
