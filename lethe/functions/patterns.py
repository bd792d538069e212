"""Detectors of identifiers with a fixed shape. Each is one regular expression and, where it has one, a check.

Word characters and digits are ASCII, so boundaries are written as explicit lookarounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import SPACE
from .text import nhs_valid

_S = f"[{SPACE}]"
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Fixed shapes: type, name, expression, group that is the hit. The order is that of the hits. The e-mail expression starts
# where a run of its characters does or where the last hit ended, which finds the same hits without trying every place of a run.
DETECTORS = (
    ("ID", "ten_digits", rf"(?<![0-9])[0-9]{{3}}(?:{_S}|-)?[0-9]{{3}}(?:{_S}|-)?[0-9]{{4}}(?![0-9])", 0),
    ("PHONE", "phone", rf"(?<![A-Za-z0-9_])(?:(?:\+44{_S}?(?:\(0\){_S}?)?[0-9]|0[0-9])(?:(?:{_S}|-)?[0-9]){{8,9}}|\(0[0-9]{{2,4}}\){_S}?[0-9]{{3,4}}(?:{_S}|-)?[0-9]{{3,4}})(?![0-9])", 0),
    ("EMAIL", "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0),
    ("ID", "ni_number", rf"(?i){_B}[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]{_S}?[0-9]{{2}}{_S}?[0-9]{{2}}{_S}?[0-9]{{2}}{_S}?[A-D]{_E}", 0),
    ("ADDRESS", "postcode", rf"(?i){_B}[A-PR-UWYZ](?:[0-9]{{1,2}}|[A-HK-Y][0-9]{{1,2}}|[0-9][A-HJKPSTUW]|[A-HK-Y][0-9][ABEHMNPRV-Y]){_S}?[0-9][ABD-HJLNP-UW-Z]{{2}}{_E}", 0),
    ("ID", "sort_code", r"(?<![0-9-])[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])", 0),
    ("DATE_OF_BIRTH", "dob", rf"(?i)(?:{_B}D\.?{_S}?O\.?{_S}?B\.?|{_B}date of birth|{_B}born(?:{_S}+on)?){_S}*[:\-\u2013]?{_S}*([0-9]{{1,2}}[/.\- ][0-9]{{1,2}}[/.\- ][0-9]{{2,4}}|[0-9]{{1,2}}(?:st|nd|rd|th)?{_S}+[A-Z][a-z]+\.?,?{_S}+[0-9]{{4}})", 1),
)


def hits(text: Column, name: str) -> Column:
    """array<string> of a detector's hits in order; a null text has none."""
    _, _, shape, group = next(d for d in DETECTORS if d[1] == name)
    found = F.coalesce(F.regexp_extract_all(text, F.lit(shape), F.lit(group)), F.array().cast("array<string>"))
    if name == "ten_digits":
        return F.filter(found, nhs_valid)
    if name == "postcode":
        return F.filter(found, lambda h: h == F.upper(h))
    return found


def pattern_hits(units: DataFrame, names: tuple[str, ...] = tuple(d[1] for d in DETECTORS)) -> DataFrame:
    """(doc_id, unit_id, ord, type, detector, text) of all hits in units(doc_id, unit_id, text), row by row without a shuffle.

    ord numbers a unit's hits: detectors in their fixed order, then by place. Hits are not deduplicated.
    """
    def typed(kind: str, name: str) -> Column:
        return F.transform(hits(F.col("text"), name), lambda h: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("detector"), h.alias("text")))

    each = [typed(kind, name) for kind, name, _, _ in DETECTORS if name in names]
    return units.select("doc_id", "unit_id", F.posexplode(F.concat(*each)).alias("ord", "h")).select("doc_id", "unit_id", "ord", "h.*")
