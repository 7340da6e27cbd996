"""Readings of one date text: every valid interpretation, as UTC microseconds."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# --- fixed values ---------------------------------------------------------
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9,
    "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12,
    "december": 12,
}
#: Usual sense of zone abbreviations, in minutes east of UTC.
USUAL_ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "UCT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60,
    "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "SAST": 120, "MSK": 180,
    "TRT": 180, "GST": 240, "PKT": 300, "IST": 330, "NPT": 345, "WIB": 420, "ICT": 420, "HKT": 480,
    "SGT": 480, "AWST": 480, "PHT": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600,
    "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "ART": -180, "NST": -210, "NDT": -150,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
ORDERS = {"MDY": (1, 0, 2), "DMY": (0, 1, 2), "YMD": (2, 1, 0)}  # places of day, month, year
#: Years in which a bare number may lie.
BARE_YEARS = (2014, 2027)
# --------------------------------------------------------------------------

EPOCH = datetime(1970, 1, 1)
SECOND = 1_000_000
_MICRO = timedelta(microseconds=1)
_BARE_LOW = (datetime(BARE_YEARS[0], 1, 1) - EPOCH) // _MICRO
_BARE_HIGH = (datetime(BARE_YEARS[1] + 1, 1, 1) - EPOCH) // _MICRO

#: Kinds of notation, as the sequence model compares them.
(ISO, YEAR_FIRST, COMPACT, MONTH_DAY, DAY_MONTH, SHORT_YEAR, DAY_NAME_MONTH, MONTH_NAME_DAY, CTIME, CJK, COUNT, DATE_NUMBER) = range(12)

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\b\.?)?"
_ZONE = (
    r"(?:\s*(?:(?P<zn>[A-Za-z]{1,5})(?![A-Za-z/_]))?\s*(?P<off>[+\-−]\d{1,2}(?::?\d{2}(?::?\d{2})?)?)?"
    r"\s*\(?(?:\[?(?P<reg>[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+|UTC|GMT)\]?|\[(?P<regz>[A-Za-z]+)\])?\)?(?:\s*\([A-Za-z ]+\))?)"
)
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_TAIL = rf"(?:[Tt,]?\s*(?:at\s+)?{_TIME}{_ZONE})?"
_MON = r"(?P<mon>[A-Za-z]{3,9})\.?"
_FLAGS = re.IGNORECASE
_YMD = re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_TAIL}\s*\Z", _FLAGS)
_PACKED = re.compile(
    rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)(?:[T ]|(?=\d{{6}}\Z))(?P<h>\d\d):?(?P<mi>\d\d)(?::?(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?P<ap>)?{_ZONE}\s*\Z", _FLAGS
)
_XXY = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<c>\d{{4}}|\d\d){_TAIL}\s*\Z", _FLAGS)
_DMONY = re.compile(rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th|\.)?(?:\s+of)?[\s\-/]*{_MON}[\s\-/,]*(?P<y>\d{{4}}){_TAIL}\s*\Z", _FLAGS)
_MONDY = re.compile(rf"{_WEEKDAY}{_MON}[\s\-]+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}\s*\Z", _FLAGS)
_CTIME = re.compile(rf"{_WEEKDAY}{_MON}\s+(?P<d>\d{{1,2}})\s+{_TIME}{_ZONE}\s+(?P<y>\d{{4}})\s*\Z", _FLAGS)
_CJK = re.compile(rf"(?P<y>\d{{4}})\s*年\s*(?P<m>\d{{1,2}})\s*月\s*(?P<d>\d{{1,2}})\s*[日号]?{_TAIL}\s*\Z", _FLAGS)
_NUMBER = re.compile(r"(?P<n>\d+)(?:\.(?P<f>\d+))?\Z")
_OUTER = " \t\r\n\f\v\"' 　﻿​"


@lru_cache(maxsize=512)
def zone_of(name: str | None) -> ZoneInfo | None:
    """The zone of an IANA name, or None."""
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


@lru_cache(maxsize=512)
def home_abbreviations(name: str | None) -> dict[str, int]:
    """Abbreviations the zone itself uses since 2000, in minutes east of UTC."""
    zone, found = zone_of(name), {}
    if zone is not None:
        for month in range(12 * 38):
            at = datetime(2000 + month // 12, month % 12 + 1, 15, 12, tzinfo=timezone.utc).astimezone(zone)
            label = at.tzname()
            if label and label.isalpha():
                found.setdefault(label.upper(), int(at.utcoffset().total_seconds() // 60))
    return found


def _utc(local: datetime, zone: ZoneInfo | None) -> int:
    """Microseconds of a local time; the earlier of two, the offset before a gap."""
    micros = (local - EPOCH) // _MICRO
    if zone is None:
        return micros
    offset = local.replace(tzinfo=zone, fold=0).utcoffset()
    return micros - offset // _MICRO


def _offset_micros(text: str) -> int | None:
    digits = text[1:].replace(":", "")
    digits = digits.zfill(2) if len(digits) <= 2 else digits
    hours, minutes, seconds = int(digits[:2]), int(digits[2:4] or 0), int(digits[4:6] or 0)
    if hours > 18 or minutes > 59 or seconds > 59:
        return None
    return (-1 if text[0] in "-−" else 1) * ((hours * 60 + minutes) * 60 + seconds) * SECOND


def _instant(year: int, month: int, day: int, parts: dict, home: str | None) -> int | None:
    """UTC microseconds of a date with the time and zone in ``parts``."""
    hour, minute, second = int(parts.get("h") or 0), int(parts.get("mi") or 0), int(parts.get("s") or 0)
    half = (parts.get("ap") or "").lower()
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half == "p" else 0)
    try:
        local = datetime(year, month, day, hour, minute, second, int(((parts.get("f") or "") + "000000")[:6]))
    except ValueError:
        return None
    offset, name = parts.get("off"), parts.get("zn")
    region = parts.get("reg") or parts.get("regz")
    if offset:
        shift = _offset_micros(offset)
        if shift is None or (name and name.upper() not in USUAL_ZONES and name.upper() not in home_abbreviations(home)):
            return None
        return (local - EPOCH) // _MICRO - shift
    if name:
        minutes = home_abbreviations(home).get(name.upper(), USUAL_ZONES.get(name.upper()))
        if minutes is None:
            return None
        return (local - EPOCH) // _MICRO - minutes * 60 * SECOND
    if region:
        zone = zone_of(region)
        return None if zone is None else _utc(local, zone)
    return _utc(local, zone_of(home))


def _bare(number: str, fraction: str | None, home: str | None) -> list[tuple[int, int]]:
    """A number alone: a calendar date, or a count of s, ms, us or ns."""
    found = []
    if len(number) == 8 and fraction is None:
        try:
            local = datetime(int(number[:4]), int(number[4:6]), int(number[6:8]))
            if BARE_YEARS[0] <= local.year <= BARE_YEARS[1]:
                found.append((DATE_NUMBER, _utc(local, zone_of(home))))
        except ValueError:
            pass
    if len(number) <= 20:
        digits = (fraction or "")[:18]
        scaled = int(number + digits)
        for unit in (1, 10**3, 10**6, 10**9):
            micros = scaled * SECOND // (unit * 10 ** len(digits))
            if _BARE_LOW <= micros < _BARE_HIGH:
                found.append((COUNT, micros))
    return found


@lru_cache(maxsize=100_000)
def readings(text: str | None, order: str | None, home: str | None) -> tuple[tuple[int, int], ...]:
    """All valid interpretations ``(kind, utc_micros)`` of a date text.

    ``order`` (MDY, DMY, YMD) settles numeric days and months and ``home`` the
    zone of times without one; where either is unknown, the possible orders
    all count and the time is read as UTC. Text that denotes no existing date
    or time has no interpretation. Finer digits than microseconds are dropped.
    """
    if not text or len(text) > 100:
        return ()
    text = text.strip(_OUTER)
    if not text:
        return ()
    found: list[tuple[int, int | None]] = []
    head = text[0]
    if "0" <= head <= "9":
        if match := _YMD.match(text):
            kind = ISO if match["sep"] == "-" else YEAR_FIRST
            found.append((kind, _instant(int(match["y"]), int(match["m"]), int(match["d"]), match.groupdict(), home)))
        elif match := _NUMBER.match(text):
            found += _bare(match["n"], match["f"], home)
            if not found and len(text) == 14 and (packed := _PACKED.match(text)):
                found.append((COMPACT, _instant(int(packed["y"]), int(packed["m"]), int(packed["d"]), packed.groupdict(), home)))
        elif match := _PACKED.match(text):
            found.append((COMPACT, _instant(int(match["y"]), int(match["m"]), int(match["d"]), match.groupdict(), home)))
        elif match := _CJK.match(text):
            found.append((CJK, _instant(int(match["y"]), int(match["m"]), int(match["d"]), match.groupdict(), home)))
        elif match := _XXY.match(text):
            numbers = (match["a"], match["b"], match["c"])
            orders = [order] if order in ORDERS and not (order == "YMD" and len(match["c"]) == 4) else ["DMY", "MDY"]
            if len(match["c"]) == 2 and order not in ORDERS:
                orders = ["DMY", "MDY", "YMD"]
            for each in orders:
                day, month, year = (int(numbers[place]) for place in ORDERS[each])
                kind = SHORT_YEAR if len(match["c"]) == 2 else MONTH_DAY if each == "MDY" else DAY_MONTH
                found.append((kind, _instant(year + 2000 if year < 100 else year, month, day, match.groupdict(), home)))
        elif (match := _DMONY.match(text)) and match["mon"].lower() in MONTHS:
            found.append((DAY_NAME_MONTH, _instant(int(match["y"]), MONTHS[match["mon"].lower()], int(match["d"]), match.groupdict(), home)))
    else:
        for kind, pattern in ((DAY_NAME_MONTH, _DMONY), (MONTH_NAME_DAY, _MONDY), (CTIME, _CTIME)):
            if (match := pattern.match(text)) and match["mon"].lower() in MONTHS:
                found.append((kind, _instant(int(match["y"]), MONTHS[match["mon"].lower()], int(match["d"]), match.groupdict(), home)))
                break
    distinct: dict[int, int] = {}
    for kind, micros in found:
        if micros is not None:
            distinct.setdefault(micros, kind)
    return tuple((kind, micros) for micros, kind in distinct.items())


def single_reading(text: str | None, order: str | None, home: str | None) -> int | None:
    """The instant of a text that has exactly one interpretation, else None."""
    found = readings(text, order, home)
    return found[0][1] if len(found) == 1 else None
