"""Aircraft registration: normalisation and extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark import fixed_values as fv
from docspark.functions.basics import (
    blank_to_null, cascade, col, extract, first_match, lookup, slashes, strip)

_BY_SUFFIX = {r[-2:]: r for r in fv.FLEET_REGISTRATIONS}
_FLEET_LETTERS = "".join(r[-1] for r in fv.FLEET_REGISTRATIONS)
_FLEET_REGEX = fv.FLEET_REGISTRATIONS[0][:-1] + f"[{_FLEET_LETTERS}]"


def normalise_registration(value: str | Column) -> Column:
    """Full registration for a complete, shortened or misread one, else null.

    Every accepted spelling (``TS-INQ``, ``INQ``, ``NQ``, ``OENQ``) is decided
    by its last two letters, so one lookup covers them all.
    """
    return lookup(F.right(F.upper(strip(value)), F.lit(2)), _BY_SUFFIX)


def listed_registration(value: Column) -> Column:
    """Active fleet first, then the alphabetically first fleet member named.

    ``value`` must be upper case; it is scanned once.
    """
    found = F.regexp_extract_all(value, F.lit(f"({_FLEET_REGEX})"))
    active = [
        F.when(F.array_contains(found, r), r) for r in fv.ACTIVE_REGISTRATIONS
    ]
    return F.coalesce(*active, F.array_min(found))


def misread_registration(text: str | Column) -> Column:
    """Registration from damaged text; patterns in order.

    The text keeps its case: upper-casing may lengthen it (ß becomes SS), and
    some patterns count characters.
    """
    patterns = [("(?i)" + p, g) for p, g in fv.REGISTRATION_DEGRADED] + [
        ("(?im)" + p, 1) for p in fv.REGISTRATION_PATTERNS]

    def tries(t: Column) -> list[Column]:
        return [
            lookup(F.right(F.upper(F.regexp_extract(t, p, g)), F.lit(2)), _BY_SUFFIX)
            for p, g in patterns]

    return cascade(text, tries)


def extract_registration(
    text: str | Column, filename: str | Column, upper: Column | None = None
) -> Column:
    """Name first, then listed names in the text, then damaged spellings.

    Pass ``upper`` when the upper-cased text is already a column.
    """
    body = F.upper(col(text)) if upper is None else upper
    return F.coalesce(
        listed_registration(F.upper(col(filename))),
        listed_registration(body),
        misread_registration(text),
    )


def registration_from_path(path: str | Column) -> Column:
    return listed_registration(F.upper(slashes(path)))


def _repair_direct(source: Column) -> Column:
    """Registration spelled with dash, blank or nothing between the parts."""
    wanted = fv.REPAIR_REGISTRATIONS
    spelled = F.transform(
        F.regexp_extract_all(source, F.lit(r"(?i)\b(TS[\s\-]?IN[A-Z])\b")),
        lambda m: F.regexp_replace(F.upper(m), r"\s", ""),
    )
    dashed = F.transform(
        spelled,
        lambda m: F.when(m.startswith("TS-"), m).otherwise(
            F.concat(F.lit("TS-"), F.substring(m, 3, 10))),
    )
    bounded = F.get(F.filter(dashed, lambda m: m.isin(wanted)), F.lit(0))
    letters = "".join(r[-1] for r in wanted)
    loose = F.array_min(
        F.transform(
            F.regexp_extract_all(
                F.upper(source), F.lit(rf"TS[\s\-]?IN([{letters}])"), F.lit(1)),
            lambda m: F.concat(F.lit("TS-IN"), m),
        ))
    return F.coalesce(bounded, loose)


def _known_msn(source: Column) -> Column:
    named = extract(source, r"(?i)\bMSN[\s:]*([0-9]{3,6})\b")
    plain = [
        F.when(source.contains(m), m) for m in fv.MSN_TO_REGISTRATION
    ]
    return F.coalesce(named, *plain)


def registration_from_msn(text: str | Column, filename: str | Column) -> Column:
    """Struct (registration, method) from a cascade of direct name, serial
    number, name fragment and serial number in the file name."""
    text = F.coalesce(col(text), F.lit(""))
    name = F.coalesce(col(filename), F.lit(""))
    upper_name = F.upper(name)
    direct = F.coalesce(_repair_direct(text), _repair_direct(name))
    msn = F.coalesce(_known_msn(text), _known_msn(name))

    def pair(registration: Column, method: Column) -> Column:
        return F.struct(
            registration.alias("registration"), method.alias("method"))

    case = F.when(direct.isNotNull(), pair(direct, F.lit("direct")))
    for number, registration in fv.MSN_TO_REGISTRATION.items():
        case = case.when(
            msn == number, pair(F.lit(registration), F.lit(f"msn_{number}")))
    case = case.when(
        upper_name.contains("INP"), pair(F.lit("TS-INP"), F.lit("filename_context")))
    case = case.when(
        upper_name.contains("INQ"), pair(F.lit("TS-INQ"), F.lit("filename_context")))
    for number, registration in fv.MSN_TO_REGISTRATION.items():
        case = case.when(
            name.contains(number),
            pair(F.lit(registration), F.lit(f"filename_msn_{number}")))
    return case.otherwise(
        pair(F.lit(None).cast("string"), F.lit("not_found")))


def extract_msn(text: str | Column) -> Column:
    return first_match(text, fv.MSN_PATTERNS)


def msn_from_entities(entities_json: str | Column) -> Column:
    """Serial number from the JSON entities: first key holding 3-5 digits."""
    def value(key: str) -> Column:
        raw = F.trim(F.get_json_object(col(entities_json), f"$.{key}"))
        return F.when(raw.rlike(r"^\d{3,5}$"), raw)

    return F.coalesce(*[value(k) for k in fv.MSN_ENTITY_KEYS])


def any_msn(entities_json: str | Column, text: str | Column) -> Column:
    return F.coalesce(msn_from_entities(entities_json), extract_msn(text))


__all__ = [
    "any_msn", "blank_to_null", "extract_msn", "extract_registration",
    "listed_registration", "misread_registration", "msn_from_entities",
    "normalise_registration", "registration_from_msn",
    "registration_from_path",
]
