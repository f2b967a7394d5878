"""Text keys, accents, keyword tests and list-valued columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters with marks and their plain forms.
ACCENTED = "ÁÀÃÂÄÅÉÈÊËÍÌÎÏÓÒÕÔÖÚÙÛÜÇÑÝáàãâäåéèêëíìîïóòõôöúùûüçñýÿ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUCNYaaaaaaeeeeiiiiooooouuuucnyy"

# Default keyword sets of the classifiers.
OUTCOME_WORDS_UPPER = ["HOMICIDIO", "FEMINICIDIO", "LATROCINIO", "MORTE", "LESAO CORPORAL SEGUIDA DE MORTE"]
OUTCOME_WORDS_LOWER = ["homicid", "latroc", "tentativa de homicid", "intervenção policial letal", "intervencao policial letal"]
TREATMENT_WORDS = ["pris", "prisa", "prisao", "detenc", "detido", "apreens", "apreensão", "prisão"]
OPERATION_TYPES = ["TRÁFICO", "MANDADO", "APREENSÃO", "PRISÃO"]


def normal_key(col: Column | str) -> Column:
    """Upper case, trimmed, runs of white space collapsed to one blank."""
    col = F.col(col) if isinstance(col, str) else col
    return F.upper(F.trim(F.regexp_replace(col, r"\s+", " ")))


def title_key(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.initcap(F.trim(F.regexp_replace(col, r"\s+", " ")))


def plain_latin(col: Column | str) -> Column:
    """Replace accented Latin letters; one pass, inside generated code."""
    col = F.col(col) if isinstance(col, str) else col
    return F.translate(col, ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def strip_marks(texts: pd.Series) -> pd.Series:
    """Decompose (NFD) and drop non-spacing marks, for any script."""

    def plain(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")

    return texts.map(plain)


def any_word(col: Column | str, words: Iterable[str]) -> Column:
    """True when the text holds any of the words, as literal substrings."""
    col = F.col(col) if isinstance(col, str) else col
    pattern = "|".join(re.escape(w) for w in words)
    return F.coalesce(col.rlike(pattern), F.lit(False))


def any_column_has(columns: Sequence[str], words: Iterable[str]) -> Column:
    """OR of :func:`any_word` over several lower-cased columns."""
    words = list(words)
    tests = [any_word(F.lower(F.col(c).cast("string")), words) for c in columns]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def description_columns(columns: Sequence[str]) -> list[str]:
    """Names that look like free descriptions; every name when none does."""
    known = {"natureza", "tipo", "descricao", "descricao_evento", "acao"}
    picked = [c for c in columns if c.lower() in known or "desc" in c.lower()]
    return picked or list(columns)


def first_of(col: Column | str, words: Sequence[str]) -> Column:
    """The first of the alternatives found in the text, else null."""
    col = F.col(col) if isinstance(col, str) else col
    found = F.regexp_extract(col, "(" + "|".join(re.escape(w) for w in words) + ")", 1)
    return F.when(found != "", found)


def pair_key(left: Column | str, right: Column | str) -> Column:
    return F.concat_ws(" / ", left, right)


def split_pair(col: Column | str) -> tuple[Column, Column]:
    parts = F.split(col, " / ", 2)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def joined_set(col: Column | str, sep: str = "|") -> Column:
    """Distinct values of a group as one sorted, separated string."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)
