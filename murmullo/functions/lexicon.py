"""The term lists behind the rule flags, and the profiles that use them.

Accents are folded when a whole-term list is compiled, so a term is listed once, in its accented
spelling. The substring list is matched with accents as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from murmullo.functions.text import ACCENTED, FOLDED

Lexicon = Mapping[str, tuple[str, ...]]

CATEGORIES = (
    "terruqueo", "fraude", "electoral_institution", "political_mention",
    "polarization", "ethnic_racial_slur", "homophobic_slur", "general_insult",
)

# Terms every whole-term profile uses.
CORE_TERMS = {
    "terruqueo": ("terruco", "terruqueo", "senderista", "rojo", "comunista", "terruca", "terrucos",
        "sendero luminoso", "movadef", "caviares"),
    "fraude": ("fraude", "robo", "fraudulento", "fraudulenta", "robaron votos", "robo electoral", "actas falsas",
        "actas perdidas", "actas duplicadas", "actas impugnadas", "mesas anuladas", "votos inflados",
        "conteo manipulado", "irregularidades", "nulidad", "impugnación"),
    "electoral_institution": ("onpe", "jne", "reniec", "personero", "personeros", "actas", "mesa", "mesas", "cédula",
        "padrón", "votos", "conteo"),
    "political_mention": ("keiko", "fujimori", "fuerza popular", "fp", "roberto sánchez", "sánchez", "jp",
        "juntos por el perú", "castillo", "perú libre", "fujimorismo", "antifujimorismo"),
    "polarization": ("zurdo", "zurdos", "caviar", "vendepatria", "corrupto", "corruptos", "dictadura", "terrorista",
        "lacra", "traidor", "mafiosa", "mafioso", "golpista", "facho", "fascista", "mafia", "delincuente",
        "criminal", "rata", "basura", "escoria"),
    "ethnic_racial_slur": ("serrano", "serrana", "serranos", "serranas", "cholo", "chola", "cholos", "cholas",
        "indio", "india", "indios", "indias", "indígena", "paisano", "provinciano", "bajado del cerro", "llama",
        "auquénido", "motoso"),
    "homophobic_slur": ("cabro", "cabros", "kbro", "kbros", "cabrón", "maricón", "marica", "rosquete", "loca"),
    "general_insult": ("csm", "ctm", "mierda", "pendejo", "pendeja", "idiota", "estúpido", "burro", "bruto",
        "imbécil", "ignorante", "payaso", "miserable", "porquería"),
}

# Further terms of the full batch and single-machine profiles.
FURTHER_TERMS = {
    "terruqueo": ("terrucada", "terruquear", "terruquean", "senderistas", "sendero", "emerretista", "mrta", "roja",
        "rojos", "comunistas", "comunacho", "comunachos"),
    "fraude": ("fraudearon", "anular mesas", "votos perdidos", "conteo lento", "trampa electoral"),
    "electoral_institution": ("boca de urna", "flash electoral"),
    "political_mention": ("reniec", "vizcarra", "pedro castillo", "lápiz", "lapicito", "cerrón", "dina", "boluarte",
        "ppk", "acuña", "césar acuña", "app", "apra", "aprista", "lópez aliaga", "rafael lópez aliaga", "rla",
        "porky", "renovación popular", "avanza país", "antauro", "humala"),
    "polarization": ("odio", "zurda", "izquierdista", "izquierdistas", "derecha bruta", "dba", "facha", "fachos",
        "fascistas", "vendepatrias", "corrupta", "corruptas", "dictador", "terroristas", "lacras", "traidora",
        "traidores", "delincuentes", "criminales", "ratas"),
    "ethnic_racial_slur": ("serranazo", "serranaza", "serranear", "cholada", "cholear", "paisana", "provinciana",
        "ignorante de la sierra", "llamas", "mote"),
    "homophobic_slur": ("kbraso", "kbrón", "cabra", "cabrita", "rosquetes"),
    "general_insult": ("pendejos", "pendejas", "vago", "vaga", "payasa", "asqueroso", "asquerosa"),
}

# Substrings of the streaming profile, accents significant.
STREAM_TERMS = {
    "terruqueo": ("terruco", "terruqueo", "senderista", "rojo", "comunista", "movadef", "mrta"),
    "fraude": ("fraude", "robo", "actas falsas", "actas impugnadas", "irregularidades"),
    "electoral_institution": ("onpe", "jne", "actas", "mesa", "personeros", "votos", "conteo"),
    "political_mention": ("keiko", "fujimori", "fp", "jp", "juntos por el peru", "juntos por el perú", "castillo",
        "peru libre", "perú libre", "antauro", "porky", "rla"),
    "polarization": ("zurdo", "caviar", "corrupto", "terrorista", "lacra", "rata", "traidor", "mafia"),
    "ethnic_racial_slur": ("cholo", "serrano", "paisano", "indio", "llama"),
    "homophobic_slur": ("kbro", "kbros", "cabro", "rosquete", "maricon", "maricón"),
    "general_insult": ("mierda", "csm", "ctm", "burro", "ignorante", "rata", "lacra"),
}

# Shortcode that marks a stream message as noise.
NOISE_SHORTCODE = ":orange_heart:"

_FOLDING = str.maketrans(ACCENTED, FOLDED)


def fold_term(term: str) -> str:
    """Spelling of a term in normalised text: lower case, accents folded, single blanks."""
    plain = term.lower().translate(_FOLDING)
    return " ".join("".join(c if c.isascii() and (c.isalnum() or c in ":_") else " " for c in plain).split())


def fold_lexicon(lexicon: Lexicon, squeeze: str | None = None) -> dict[str, tuple[str, ...]]:
    """Folded terms per category; runs shrink as they do in the text to match."""
    def fold(term: str) -> str:
        folded = fold_term(term)
        return re.sub(r"(.)\1{2,}", r"\1", folded) if squeeze else folded

    return {
        category: tuple(dict.fromkeys(filter(None, map(fold, terms))))
        for category, terms in lexicon.items()
    }


def merge(*parts: Mapping[str, Iterable[str]]) -> dict[str, tuple[str, ...]]:
    """Union of lexicons, category by category, first mention first."""
    merged: dict[str, dict[str, None]] = {category: {} for category in CATEGORIES}
    for part in parts:
        for category, terms in part.items():
            merged.setdefault(category, {}).update(dict.fromkeys(terms))
    return {category: tuple(terms) for category, terms in merged.items()}


@dataclass(frozen=True)
class RuleProfile:
    """How one variant of the rule engine reads a message.

    text         'message' (raw only), 'clean_first' (clean, else raw; null is missing) or
                 'clean_non_empty' (clean, else raw; empty is missing)
    squeeze      see :func:`murmullo.functions.text.norm_text`; 'stream' keeps accents
    match        'term' for whole terms, 'substring' for containment
    implied_polarization  any strong category beside a political mention polarises
    noise        'full', 'short', 'stream' or 'unicode'
    short_limit  messages with at most this many characters (blanks aside) are noise
    noise_penalty, insult_weight  switches of the risk score
    """

    name: str
    lexicon: Lexicon
    text: str
    squeeze: str | None
    match: str = "term"
    implied_polarization: bool = True
    noise: str = "full"
    short_limit: int = 2
    noise_penalty: bool = True
    insult_weight: int = 0

    def with_terms(self, extra: Mapping[str, Iterable[str]]) -> "RuleProfile":
        return replace(self, lexicon=merge(self.lexicon, extra))

    def with_lexicon(self, lexicon: Mapping[str, Iterable[str]]) -> "RuleProfile":
        return replace(self, lexicon=merge(lexicon))

    def with_short_limit(self, limit: int) -> "RuleProfile":
        return replace(self, short_limit=limit)


_CORE = merge(CORE_TERMS)
_FULL = merge(CORE_TERMS, FURTHER_TERMS)

PROFILES = {
    "v1": RuleProfile("v1", _FULL, text="message", squeeze="vowels"),
    "k": RuleProfile("k", _CORE, text="clean_first", squeeze=None, noise="short", noise_penalty=False),
    "s": RuleProfile(
        "s", merge(STREAM_TERMS), text="clean_non_empty", squeeze="stream", match="substring",
        implied_polarization=False, noise="stream", noise_penalty=False, insult_weight=1,
    ),
    "l": RuleProfile("l", _FULL, text="message", squeeze="any", noise="unicode"),
}


def profile(name: str | RuleProfile) -> RuleProfile:
    return name if isinstance(name, RuleProfile) else PROFILES[name]


LEXICON_SCHEMA = "profile string, category string, term string"


def lexicon_frame(spark: SparkSession, lexicon: Lexicon, name: str = "custom") -> DataFrame:
    """(profile, category, term) rows of a lexicon, terms folded."""
    rows = [(name, category, term) for category, terms in fold_lexicon(lexicon).items() for term in terms]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def load_lexicon(spark: SparkSession, path: str, profile_name: str) -> dict[str, tuple[str, ...]]:
    """One profile of a (profile, category, term) CSV file as a lexicon.

    The terms become literals of the plan, as a profile's own terms are. A term table that is data rather
    than settings isn't loaded but joined: see operators.terms.join_lexicon.
    """
    rows = (
        spark.read.schema(LEXICON_SCHEMA).option("header", True).csv(path)
        .where(f"profile = '{profile_name}'").select("category", "term").distinct()
        .orderBy("category", "term").collect()
    )
    lexicon: dict[str, list[str]] = {}
    for category, term in rows:
        lexicon.setdefault(category, []).append(term)
    return merge(lexicon)
