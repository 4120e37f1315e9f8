"""Text matching for the entity linker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem


#: White space of all scripts, and the four separators of ASCII.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def normalize_text(text: Column) -> Column:
    """In lower case, with one space for any white space."""
    return F.trim(F.regexp_replace(F.lower(text), f"{BLANK}+", " "))


def ticker_like(text: Column) -> Column:
    return F.length(text).between(1, 6) & text.rlike(r"^[A-Z]{1,5}(\.[A-Z])?$")


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased words, each padded by two blanks in front and one behind."""
    grams = F.transform(words_of(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, for two trigram arrays."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / every)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


#: English words that a full-text query ignores (fixed values).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """The stem of each word."""
    return words.map(stem, na_action="ignore")


def words_of(text: Column) -> Column:
    """The lower-cased words: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
