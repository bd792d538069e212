"""Predicates and scalar functions over text columns, built from Spark's own expressions.

Offsets are code points. The one exception to native expressions is compatibility normalisation, which Spark has no
function for and which is only applied to terms and names, never to document texts in bulk.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import FAMILY_WORDS, PARTICLES, SPACE, TITLES, TYPES

WS = f"[{SPACE}]"
ALNUM = r"[\p{L}\p{N}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(trimmed(c), F.lit("")) == ""


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def solid_length(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(c, WS, ""))


def needs_ocr(c: Column) -> Column:
    """Whether a page's text layer is a scan's: under 25 visible characters, or over a tenth of them undecodable."""
    n = solid_length(c)
    return (n < 25) | (F.regexp_count(c, F.lit("\uFFFD")) * 10 > n)


def is_searchable(c: Column) -> Column:
    """Whether a detector's candidate is worth looking for: 2 to 200 characters, no label, not a number of 1 to 3 digits."""
    return F.length(c).between(2, 200) & ~c.rlike(r"^\[[^\]]*\]$") & ~c.rlike(r"^[0-9]{1,3}$")


def is_recent_date(c: Column, as_of_year: int) -> Column:
    """Whether the first year named is last year or later."""
    year = F.regexp_extract(c, r"(?<![0-9A-Za-z_])((?:19|20)[0-9]{2})(?![0-9A-Za-z_])", 1)
    return F.coalesce(F.expr("1") * F.when(year != "", year.cast("int")) >= as_of_year - 1, F.lit(False))


def is_number_like(c: Column) -> Column:
    """At least six digits that are at least six tenths of the visible characters."""
    n = F.length(digits(c))
    return (n >= 6) & (n * 10 >= solid_length(c) * 6)


def is_label(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\[[A-Za-z][A-Za-z ]{0,30}(?: [0-9]{1,4})?\]$"), F.lit(False))


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def is_name_shaped(c: Column) -> Column:
    """One to five words, each capitalised or a particle, without list punctuation."""
    w = words(c)
    good = F.forall(w, lambda x: x.rlike(r"^\p{Lu}") | F.lower(x).isin(PARTICLES))
    return ~c.rlike("[,;:()]") & F.size(w).between(1, 5) & good


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    return F.pandas_udf(_nfkc, "string")(c)


def folded(c: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, trimmed; c is taken as normalised."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def normalised(c: Column) -> Column:
    return folded(nfkc(c))


def is_family_word(c: Column) -> Column:
    return folded(c).isin(FAMILY_WORDS)


def canonical(kind: Column, norm: Column) -> Column:
    """type:normalised, a person's titles left out."""
    bare = F.array_join(F.filter(F.split(norm, " "), lambda w: ~w.isin(TITLES)), " ")
    return F.concat(kind, F.lit(":"), F.when(kind == "PERSON", bare).otherwise(norm))


def label_name(kind: Column, which: int = 0) -> Column:
    """The name of a type in labels (0) or lists (1); an unknown type is shown as OTHER."""
    table = F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (k, v[which])))
    return F.coalesce(F.element_at(table, kind), F.lit(TYPES["OTHER"][which]))


def url_decoded(c: Column) -> Column:
    """Percent-decoded, a plus staying one; the text itself where that fails."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def base_name(c: Column) -> Column:
    """Last part of a path without its extension of one to five letters or digits, at most 150 characters."""
    leaf = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.substring(F.regexp_replace(leaf, r"\.[A-Za-z0-9]{1,5}$", ""), 1, 150)


def nhs_valid(c: Column) -> Column:
    """Whether ten digits end in their modulus-11 check digit and do not begin with 0."""
    d = digits(c)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + (11 - i) * F.try_to_number(F.substr(F.rpad(d, 10, "0"), i, F.lit(1)), F.lit("9")).cast("int"))
    check = 11 - total % 11
    last = F.substring(d, 10, 1)
    return (F.length(d) == 10) & ~d.startswith("0") & (check != 10) & (F.when(check == 11, 0).otherwise(check).cast("string") == last)
