"""Folding of names to comparison keys, and parsing of Bayer-style designations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks that fold away, and the Greek letters with their abbreviations and English names.
APOSTROPHES = "\u02bb\u02bc\u2018\u2019'"
GREEK = "α β γ δ ε ζ η θ ι κ λ μ ν ξ ο π ρ σ τ υ φ χ ψ ω".split()
ABBREVIATIONS = "alf bet gam del eps zet eta the iot kap lam mu nu xi omi pi rho sig tau ups phi chi psi ome".split()
SPELLED = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()

_ASCII_KEY = re.compile(r"[^a-z0-9]+")
_LETTER_OF = {spelling: i for row in (SPELLED, ABBREVIATIONS, GREEK) for i, spelling in enumerate(row)}


def fold(text: str) -> str:
    """The search key of one text: compatibility-folded, without marks, case or anything but letters and digits."""
    if text.isascii():
        return _ASCII_KEY.sub("", text.lower())
    letters = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text))
    kept = "".join(c for c in letters if c not in APOSTROPHES and not unicodedata.combining(c))
    return "".join(filter(str.isalnum, kept.casefold()))


def _fold_all(texts: Iterable[str | None]) -> list[str | None]:
    known: dict[str | None, str | None] = {None: None}
    out = []
    for text in texts:
        if text not in known:
            known[text] = fold(text)
        out.append(known[text])
    return out


def search_key(column: Column | str) -> Column:
    """Search key of a text column; null stays null, a text of marks only gives ''. Texts of ASCII do not leave the JVM."""
    text = F.col(column) if isinstance(column, str) else column
    plain = F.octet_length(text) == F.char_length(text)

    @F.pandas_udf(T.StringType())
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series(_fold_all(texts), dtype=object)

    return F.when(plain, ascii_search_key(text)).otherwise(key(F.when(~plain, text)))


def ascii_search_key(column: Column | str) -> Column:
    """The search key of texts known to be ASCII, without leaving the JVM."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def designation(raw: str) -> tuple[str, str | None, str | None, str | None, str | None]:
    """(kind, letter, superscript, constellation, component) of a Bayer, Flamsteed or variable-star designation."""
    words = unicodedata.normalize("NFKC", raw).split()[:3]
    if not words:
        return "unparsed", None, None, None, None
    head, constellation, component = (words + [None, None])[:3]
    if re.fullmatch(r"V\d+", head):
        return "variable", None, None, constellation, component
    if head.isdigit():
        return "flamsteed", head, None, constellation, component
    stem = head.rstrip("".join({c for c in head if c.isdecimal()})) if head[-1].isdecimal() else head
    superscript = head[len(stem) :] or None
    # Greek letters count in lower case only, Latin spellings in any.
    at = _LETTER_OF.get(stem if stem in GREEK else stem.casefold() if stem.casefold() not in GREEK else "")
    if at is None:
        return "unparsed", None, superscript, constellation, component
    return "bayer", ABBREVIATIONS[at], superscript, constellation, component


def designation_forms(raw: str) -> list[str]:
    """Greek, abbreviated and spelled-out form of a Bayer designation; nothing for other kinds."""
    kind, letter, superscript, constellation, component = designation(raw)
    if kind != "bayer" or not constellation:
        return []
    at = ABBREVIATIONS.index(letter)
    tail = " ".join(filter(None, [(superscript or "") + " " + constellation, component]))
    return [head + tail for head in (GREEK[at], letter, SPELLED[at].capitalize())]


DESIGNATION_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "letter", "superscript", "constellation", "component", "raw")])


def parse_designation(column: Column | str) -> Column:
    """Struct (kind, letter, superscript, constellation, component, raw); null stays null."""

    @F.pandas_udf(DESIGNATION_TYPE)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        rows = [[None] * 6 if t is None else [*designation(t), t] for t in texts]
        return pd.DataFrame(rows, columns=DESIGNATION_TYPE.names, dtype=object)

    return parsed(column)


def designation_aliases(column: Column | str) -> Column:
    """Array of the alias forms of a designation; empty for null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def forms(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else designation_forms(t) for t in texts], dtype=object)

    return forms(column)
