"""Quantities recorded in different units, converted to one common unit per attribute.

A recorded quantity is read in all the ways its notation allows: which number of the text, which
unit, which power of ten. Physical identities tie readings together, such as
``mass = density * volume`` between the columns of a table, or ``text = value`` between two records
of one measurement. Of all combinations of readings the one with the least sum of squared log
residuals is chosen, and a choice is flagged as not unique where another combination that gives
other quantities fits as well (:func:`choose_readings`).

``measured_attributes`` applies this to the elements of ``entities.attributes``: the readings come
from the text that holds (``raw_text`` unless it is blank, else ``value`` and ``unit``); the record in
``value`` and ``unit`` is the other side of the identity and decides only between readings of that
text. Readings whose unit belongs to another kind of quantity are no candidates.

Cases: null or empty arrays give no rows; null or blank names, texts and units, ranges,
placeholders, shares, texts without a unit and quantities whose thousandths are beyond 64 bits give none;
numbers of any length are read whole; repeated rows count once; very long texts are read whole.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut

# Kind of quantity -> common unit; units with their exact factor to it. Temperature
# units carry (factor, offset): kelvin = value * factor + offset.
_LB, _G = Fraction("0.45359237"), Fraction("9.80665")
_IN, _NM = Fraction("0.0254"), Fraction(1852)
COMMON_UNITS = {
    "mass": "kg", "thrust": "N", "power": "W", "length": "m", "temperature": "K", "voltage": "V", "data_rate": "Mbit/s",
    "pressure": "MPa", "pointing": "deg", "frequency": "MHz", "delta_v": "m/s", "energy": "kJ", "duration": "s",
}
SPELLINGS: dict[str, dict[str, tuple[str, ...]]] = {
    "mass": {
        "1": ("kg", "kgs", "kilogram", "kilograms", "kilogramme", "kilogrammes"),
        "1/1000": ("g", "gram", "grams", "gramme", "grammes"),
        "1/1000000": ("mg", "milligram", "milligrams"),
        "1/1000000000": ("ug", "µg", "microgram", "micrograms"),
        "1000": ("t", "tonne", "tonnes", "metric ton", "metric tons"),
        "lb": ("lb", "lbs", "lbm", "pound", "pounds"),
        "lb/16": ("oz", "ounce", "ounces"),
    },
    "thrust": {
        "1": ("n", "newton", "newtons"),
        "1/1000": ("mn", "millinewton", "millinewtons"),
        "1/1000000": ("un", "µn", "micronewton", "micronewtons"),
        "1000": ("kn", "kilonewton", "kilonewtons"),
        "1000000": ("meganewton", "meganewtons"),
        "g": ("kgf", "kilogram-force", "kilograms-force", "kp"),
        "lb*g": ("lbf", "pound-force", "pounds-force", "pound force", "pounds force"),
    },
    "power": {
        "1": ("w", "watt", "watts"),
        "1/1000": ("mw", "milliwatt", "milliwatts"),
        "1/1000000": ("uw", "µw", "microwatt", "microwatts"),
        "1000": ("kw", "kilowatt", "kilowatts"),
        "1000000": ("megawatt", "megawatts"),
    },
    "length": {
        "1": ("m", "metre", "metres", "meter", "meters"),
        "1/100": ("cm", "centimetre", "centimetres", "centimeter", "centimeters"),
        "1/1000": ("mm", "millimetre", "millimetres", "millimeter", "millimeters"),
        "1/1000000": ("um", "µm", "micron", "microns", "micrometre", "micrometres", "micrometer", "micrometers"),
        "1/1000000000": ("nm", "nanometre", "nanometres", "nanometer", "nanometers"),
        "1000": ("km", "kilometre", "kilometres", "kilometer", "kilometers"),
        "in": ("in", "inch", "inches", "″", '"'),
        "12*in": ("ft", "foot", "feet", "′", "'"),
        "36*in": ("yd", "yard", "yards"),
        "63360*in": ("mi", "mile", "miles"),
    },
    "voltage": {
        "1": ("v", "volt", "volts", "vdc", "vac", "v dc", "v ac"),
        "1/1000": ("mv", "millivolt", "millivolts"),
        "1/1000000": ("uv", "µv", "microvolt", "microvolts"),
        "1000": ("kv", "kilovolt", "kilovolts"),
    },
    "data_rate": {
        "1": ("mbit/s", "mbps", "mb/s", "megabit per second", "megabits per second"),
        "1/1000": ("kbit/s", "kbps", "kb/s", "kilobit per second", "kilobits per second"),
        "1/1000000": ("bit/s", "bps", "b/s", "bit per second", "bits per second"),
        "1000": ("gbit/s", "gbps", "gb/s", "gigabit per second", "gigabits per second"),
        "1000000": ("tbit/s", "tbps"),
        "8": ("megabyte per second", "megabytes per second", "mbyte/s"),
        "8/1000": ("kilobyte per second", "kilobytes per second", "kbyte/s"),
        "8/1000000": ("byte/s", "bytes/s", "byte per second", "bytes per second"),
        "8000": ("gigabyte per second", "gigabytes per second", "gbyte/s"),
    },
    "pressure": {
        "1": ("mpa", "megapascal", "megapascals", "n/mm²", "n/mm2"),
        "1/1000": ("kpa", "kilopascal", "kilopascals"),
        "1/10000": ("hpa", "mbar", "hectopascal", "hectopascals", "millibar", "millibars"),
        "1/1000000": ("pa", "pascal", "pascals"),
        "1000": ("gpa", "gigapascal", "gigapascals"),
        "1/10": ("bar", "bars"),
        "101325/1000000": ("atm", "atmosphere", "atmospheres"),
        "101325/760000000": ("torr",),
        "lb*g/(in*in)/1000000": ("psi", "psia", "psig", "lbf/in²", "lbf/in2", "lbf/in^2", "pounds per square inch"),
    },
    "pointing": {
        "1": ("deg", "degs", "degree", "degrees", "°", "º"),
        "1/60": ("arcmin", "arcmins", "arcminute", "arcminutes", "′", "'", "’"),
        "1/3600": ("arcsec", "arcsecs", "arcsecond", "arcseconds", "″", '"', "”"),
        "rad": ("rad", "radian", "radians"),
        "rad/1000": ("mrad", "milliradian", "milliradians"),
        "rad/1000000": ("urad", "µrad", "microradian", "microradians"),
    },
    "frequency": {
        "1": ("mhz", "megahertz"),
        "1/1000": ("khz", "kilohertz"),
        "1/1000000": ("hz", "hertz"),
        "1000": ("ghz", "gigahertz"),
        "1000000": ("thz", "terahertz"),
    },
    "delta_v": {
        "1": ("m/s", "m s^-1", "m s-1", "m s⁻¹", "m·s^-1", "m*s^-1", "ms^-1", "mps", "metre per second", "metres per second", "meter per second", "meters per second"),
        "1000": ("km/s", "km s^-1", "km s⁻¹", "kilometre per second", "kilometres per second", "kilometer per second", "kilometers per second"),
        "1/100": ("cm/s",),
        "1/1000": ("mm/s",),
        "10/36": ("km/h", "kph", "kmh", "km/hr", "kilometres per hour", "kilometers per hour"),
        "12*in": ("ft/s", "fps", "feet per second", "foot per second"),
        "17.6*in": ("mph", "mi/h", "miles per hour"),
        "1852/3600": ("kn", "kt", "kts", "knot", "knots"),
    },
    "energy": {
        "1": ("kj", "kilojoule", "kilojoules"),
        "1/1000": ("j", "joule", "joules", "ws", "watt-second", "watt-seconds"),
        "1/1000000": ("mj_milli", "millijoule", "millijoules"),
        "1000": ("mj", "megajoule", "megajoules"),
        "3.6": ("wh", "watt-hour", "watt-hours", "watt hour", "watt hours"),
        "3.6/1000": ("mwh_milli", "milliwatt-hour", "milliwatt-hours"),
        "3600": ("kwh", "kilowatt-hour", "kilowatt-hours", "kilowatt hour", "kilowatt hours"),
    },
    "duration": {
        "1": ("s", "sec", "secs", "second", "seconds"),
        "1/1000": ("ms", "msec", "millisecond", "milliseconds"),
        "1/1000000": ("us", "µs", "microsecond", "microseconds"),
        "60": ("min", "mins", "minute", "minutes"),
        "3600": ("h", "hr", "hrs", "hour", "hours"),
        "86400": ("d", "day", "days"),
        "604800": ("wk", "week", "weeks"),
    },
}
TEMPERATURES: dict[str, tuple[tuple[str, ...], Fraction, Fraction]] = {
    "K": (("k", "kelvin", "kelvins", "degk", "deg k", "°k"), Fraction(1), Fraction(0)),
    "C": (("c", "°c", "º c", "° c", "degc", "deg c", "celsius", "degrees c", "degrees celsius", "deg celsius", "℃"), Fraction(1), Fraction("273.15")),
    "F": (("f", "°f", "° f", "degf", "deg f", "fahrenheit", "degrees f", "degrees fahrenheit", "deg fahrenheit", "℉"), Fraction(5, 9), Fraction("459.67") * Fraction(5, 9)),
    "R": (("°r", "degr", "deg r", "rankine"), Fraction(5, 9), Fraction(0)),
}
#: Where only upper case tells two units apart: spelled exactly so, they mean this.
EXACT_CASE: dict[str, dict[str, str]] = {
    "thrust": {"MN": "1000000", "mN": "1/1000", "kN": "1000", "N": "1"},
    "power": {"MW": "1000000", "mW": "1/1000"},
    "data_rate": {"MB/s": "8", "kB/s": "8/1000", "KB/s": "8/1000", "GB/s": "8000", "B/s": "8/1000000", "MBps": "8", "GBps": "8000", "kBps": "8/1000"},
    "energy": {"mJ": "1/1000000", "MJ": "1000", "mWh": "3.6/1000", "MWh": "3600000"},
    "voltage": {"MV": "1000000", "mV": "1/1000"},
    "frequency": {"mHz": "1/1000000000", "MHz": "1"},
    "pressure": {"mPa": "1/1000000000", "MPa": "1"},
    "mass": {"Mg": "1000", "mg": "1/1000000"},
    "length": {"Mm": "1000000", "mm": "1/1000"},
}
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())} | {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
MULTIPLIERS = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}

#: Half a turn in degrees over pi, to more places than any rounding to thousandths can need.
_RAD = Fraction(180) / Fraction("3.14159265358979323846264338327950288419716939937510")
_NAMES = {"lb": _LB, "g": _G, "in": _IN, "rad": _RAD}
#: Tens by which any unit here and the rounding to thousandths can shift a number, and more: beyond, a
#: result cannot be within 64 bits, or cannot differ from zero.
_FAR = 60


@lru_cache(None)
def _factor(formula: str) -> Fraction:
    value = Fraction(1)
    for op, token in re.findall(r"([*/]?)\(?([a-z]+|[\d.]+)\)?", formula.replace("(in*in)", "in/in")):
        x = _NAMES.get(token) or Fraction(token)
        value = value / x if op == "/" else value * x
    return value


@dataclass(frozen=True)
class Unit:
    kind: str
    factor: Fraction
    offset: Fraction = Fraction(0)


def _unit_tables() -> tuple[dict[tuple[str, str], Unit], dict[tuple[str, str], Unit], dict[str, set[str]]]:
    exact: dict[tuple[str, str], Unit] = {}
    folded: dict[tuple[str, str], Unit] = {}
    for kind, table in SPELLINGS.items():
        for formula, names in table.items():
            for n in names:
                folded[kind, n] = Unit(kind, _factor(formula))
        for n, formula in EXACT_CASE.get(kind, {}).items():
            exact[kind, n] = Unit(kind, _factor(formula))
    for names, factor, offset in TEMPERATURES.values():
        for n in names:
            folded["temperature", n] = Unit("temperature", factor, offset)
    kinds: dict[str, set[str]] = {}
    for k, n in folded:
        kinds.setdefault(n, set()).add(k)
    return exact, folded, kinds


EXACT, FOLDED, KINDS_OF = _unit_tables()
_SPELLED = sorted({n for _, n in FOLDED} | {n.lower() for _, n in EXACT}, key=lambda n: (-len(n), n))
_UNIT = "|".join(re.escape(n).replace(r"\ ", r"\s*") for n in _SPELLED)
_WORDS = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
# Groups of three digits are set off by a comma, an apostrophe or a plain, fixed or thin space.
_GAP = " \u00a0\u2007\u2009\u202f"
_DIGITS = rf"\d{{1,3}}(?:[,'’]\d{{3}}(?!\d))+(?:\.\d+)?|\d{{1,3}}(?:[{_GAP}]\d{{3}}(?![\d.,]\d|\d))+(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+"
_GROUPED = re.compile(rf"\d{{1,3}}(?:[,'’{_GAP}]\d{{3}})+(?:\.\d+)?")
_NUMBER = re.compile(
    rf"""(?P<num>(?<![\w.])(?P<sign>[-+−])?\s?(?:(?P<mixed>\d+\s)?(?P<up>\d+)\s?[/⁄]\s?(?P<down>\d+)|(?P<digits>{_DIGITS}))
        (?:\s?[x×*·]\s?10\s?(?:\^|\*\*)?\s?(?P<pow>[-+−]?\d+|[⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)|[eE](?P<exp>[-+−]?\d+)(?![A-Za-z\d]))?
        |(?<![\w-])(?P<word>(?:{_WORDS})(?:[-\s](?:{_WORDS}))?)(?![\w]))
        (?P<mult>(?:\s?(?:{"|".join(MULTIPLIERS)})\b)*)
        (?P<plus>\s?(?:±|\+/-|\+-)\s?[\d.,]+\s?%?)?""",
    re.X | re.I,
)
_UNIT_AT = re.compile(rf"\s?(?P<u>{_UNIT})(?![^\W_])(?!\^)", re.I)
_RANGE = re.compile(r"\s?(?:–|—|-|\.\.\.?|…|\bto\b|\band\b|\bbis\b|~)\s?$", re.I)
_SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻−", "0123456789+--")


def unit_of(kind: str, spelled: str) -> Unit | None:
    """The unit of the kind that a spelling means; exact case first where case tells units apart."""
    spelled = re.sub(r"\s+", " ", spelled.strip())
    return EXACT.get((kind, spelled)) or FOLDED.get((kind, spelled.lower().replace("μ", "µ"))) or FOLDED.get((kind, spelled.lower().replace(" ", "")))


def _whole(digits: str) -> int:
    """A whole number of any length; the interpreter's own reading refuses very long ones."""
    digits = re.sub(r"\s", "", digits)
    if len(digits) <= 4000:
        return int(digits or "0")
    sign = -1 if digits[0] == "-" else 1
    digits = digits.lstrip("+-")
    half = len(digits) // 2
    return sign * (_whole(digits[:half]) * 10 ** (len(digits) - half) + _whole(digits[half:]))


def _value(m: re.Match) -> Fraction | None:
    if m["word"]:
        parts = re.split(r"[-\s]", m["word"].lower())
        x = Fraction(sum(NUMBER_WORDS[p] for p in parts))
    elif m["up"]:
        down = _whole(m["down"])
        if not down:
            return None
        x = Fraction(_whole(m["up"]), down) + _whole(m["mixed"] or "0")
    else:
        d = m["digits"]
        if _GROUPED.fullmatch(d):
            d = re.sub(rf"[,'’{_GAP}]", "", d)
        whole, _, part = d.replace(",", ".").partition(".")
        x = Fraction(_whole(whole + part), 10 ** len(part))
    if m["pow"] or m["exp"]:
        e = _whole((m["pow"] or m["exp"]).translate(_SUPERSCRIPTS))
        tens = (len(str(x.numerator)) if x.numerator < 10**4000 else x.numerator.bit_length() * 3 // 10) - x.denominator.bit_length() * 3 // 10 + e
        if not x or tens < -_FAR:
            x = Fraction(0)
        elif tens > _FAR:
            return None
        else:
            x *= Fraction(10) ** e
    for w in re.findall(r"[a-z]+", (m["mult"] or "").lower()):
        x *= MULTIPLIERS[w]
    return -x if m["sign"] in ("-", "−") else x


@dataclass(frozen=True)
class Reading:
    """One way to read a quantity out of a text, in the common unit of its kind."""

    quantity: Fraction


def readings(kind: str, text: str) -> list[Reading]:
    """All quantities of ``kind`` that ``text`` may state, in order of preference.

    A number counts with the unit directly behind it (behind a tolerance, if one follows). Numbers
    of one quantity in falling units (7 d 3 h) add up. A number that is an end of a range counts
    not at all, nor does the range.
    """
    text = unicodedata.normalize("NFC", text).replace("\u00ad", "")
    found: list[tuple[int, int, Fraction, Unit | None]] = []
    at = 0
    while m := _NUMBER.search(text, at):
        at = m.end()
        value = _value(m)
        if value is None:
            continue
        unit, end = None, m.end()
        after = _UNIT_AT.match(text, m.end())
        # A shorter spelling may be the one that this kind knows.
        if after:
            unit, end = unit_of(kind, after["u"]), after.end()
            if unit is None and kind not in KINDS_OF.get(after["u"].lower(), ()):
                unit = None
        found.append((m.start(), end, value, unit))
        at = max(at, end if after else at)
    out: list[Reading] = []
    skip: set[int] = set()
    for i in range(len(found) - 1):
        between = text[found[i][1] : found[i + 1][0]]
        joined = _RANGE.fullmatch(between) or (between.strip() == "" and text[found[i + 1][0]] in "-−" and found[i][1] == found[i + 1][0])
        if joined and (found[i + 1][3] is not None or found[i][3] is not None):
            skip |= {i, i + 1}
    i = 0
    while i < len(found):
        start, end, value, unit = found[i]
        if unit is None or i in skip:
            i += 1
            continue
        total, j, last = value * unit.factor + unit.offset, i + 1, unit
        while (
            j < len(found) and j not in skip and kind != "temperature" and found[j][3] is not None and found[j][3].factor < last.factor
            and found[j][2] >= 0 and re.fullmatch(r"\s*(?:,|and)?\s*", text[found[j - 1][1] : found[j][0]])
        ):
            total += found[j][2] * found[j][3].factor * (-1 if value < 0 else 1)
            last = found[j][3]
            j += 1
        out.append(Reading(total))
        i = j
    return out


def log_residual(x: Fraction, y: Fraction) -> float:
    """Distance of two quantities on the logarithmic scale; infinite across zero or sign."""
    if x == y:
        return 0.0
    if not x or not y or (x < 0) != (y < 0):
        return math.inf
    return abs(math.log(abs(x.numerator)) - math.log(x.denominator) - math.log(abs(y.numerator)) + math.log(y.denominator))


def choose_readings(candidates: Mapping[str, Sequence[Fraction]], identities: Sequence[tuple[Mapping[str, int], float]], tolerance: float = 0.02) -> tuple[dict[str, Fraction], bool]:
    """The combination of readings that fits the identities best, and whether it is the only one.

    ``candidates``: per column the quantities it may mean, preferred ones first. An identity is
    a product of powers of columns that equals a constant: ``({"mass": 1, "density": -1,
    "volume": -1}, 1.0)``. It counts where all its columns have a candidate. The sum of squared log
    residuals decides; of equal fits the earlier reading stands, but the choice is not unique where
    a combination that gives another quantity fits as well within ``tolerance``.
    Candidates per column are few (the readings of one notation), so combinations are enumerated.
    """
    columns = [c for c in candidates if candidates[c]]
    used = [(p, k) for p, k in identities if all(c in columns for c in p)]
    best, best_cost, ties = None, math.inf, []
    for combo in itertools.product(*[candidates[c] for c in columns]):
        pick = dict(zip(columns, combo))
        cost = 0.0
        for p, k in used:
            if any(pick[c] == 0 for c in p) or math.prod((1 if pick[c] > 0 else -1) ** abs(e) for c, e in p.items()) < 0:
                cost += 1e6
                continue
            cost += (sum(e * (math.log(abs(pick[c].numerator)) - math.log(pick[c].denominator)) for c, e in p.items()) - math.log(k)) ** 2
        if best is None or cost < best_cost - tolerance**2:
            best, best_cost = pick, cost
            ties = [t for t in ties if t[1] <= cost + tolerance**2]
        ties.append((pick, cost))
    if best is None:
        return {}, True
    return best, not any(t[0] != best and t[1] <= best_cost + tolerance**2 for t in ties)


@lru_cache(200_000)
def measured(name: str | None, raw_text: str | None, value: str | None, unit: str | None) -> tuple[int | None, bool]:
    """Thousandths of the common unit (null where there is no determinable quantity); unique or not."""
    if name not in COMMON_UNITS:
        return None, True
    stated = " ".join(x.strip() for x in (value, unit) if x and x.strip())
    holds = raw_text if raw_text and raw_text.strip() else stated
    text = [r.quantity for r in readings(name, holds)]
    if not text:
        return None, True
    # The second record of the same measurement; the identity is text = record.
    record = [r.quantity for r in readings(name, stated)][:1]
    pick, unique = choose_readings({"text": text, "record": record}, [({"text": 1, "record": -1}, 1.0)])
    thousandths = pick["text"] * 1000
    whole = (abs(thousandths) * 2 + 1) // 2
    if whole >= 1 << 63:
        return None, unique
    return int(whole if thousandths >= 0 else -whole), unique


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [measured(*t) for t in zip(*(b[c].where(b[c].notna(), None) for c in ("name", "raw_text", "value", "unit")))]
        out = b[["entity_id", "attr_ix"]].assign(value_milli=pd.array([g[0] for g in got], dtype="Int64"), is_unique=[g[1] for g in got])
        yield out[out.value_milli.notna()]


def measured_attributes(entities: DataFrame) -> DataFrame:
    """entity_id, attr_ix, value_milli, is_unique: every determinable quantity of ``attributes``."""
    elements = (
        entities.select(F.col("id").alias("entity_id"), F.posexplode("attributes").alias("attr_ix", "a"))
        .where(F.col("entity_id").isNotNull() & F.col("a.name").isin(list(COMMON_UNITS)))
        .select("entity_id", "attr_ix", *[F.col(f"a.{c}").alias(c) for c in ("name", "raw_text", "value", "unit")])
    )
    return elements.mapInPandas(_measure, "entity_id string, attr_ix int, value_milli bigint, is_unique boolean").distinct()


def record_units(entities: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """name, unit, meant, rms, is_unique: the units in which ``value`` is recorded, by attribute and unit as spelled.

    A source is an attribute together with the unit text of its record (null where it is blank). The
    identity is that the recorded number, in one of the attribute's units, is the quantity that
    ``raw_text`` states; :func:`source_units` finds the unit that leaves the least log residuals over all
    records of the source. Where units are wrong or missing at random no unit fits and ``rms`` is large.
    Temperatures, whose scales are no factors, and records without a number or a quantity in the text have no rows.
    """

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, raw, value, unit in b[["name", "raw_text", "value", "unit"]].where(b.notna(), None).itertuples(index=False):
                number = re.fullmatch(r"\s*\d+(?:\.\d+)?\s*", value or "")
                got = readings(name, raw) if raw and number else []
                if got and 0 < got[0].quantity < 10**15:
                    out.append((name, unit.strip() if unit and unit.strip() else None, float(got[0].quantity), float(number[0])))
            yield pd.DataFrame(out, columns=["name", "unit", "stated", "recorded"])

    named = entities.select(F.explode("attributes").alias("a")).select("a.*").where(F.col("name").isin(sorted(SPELLINGS)))
    rows = cut(named.mapInPandas(both, "name string, unit string, stated double, recorded double").withColumn("source", F.struct("name", "unit")))
    out = None
    for kind, table in SPELLINGS.items():
        factors = {float(_factor(formula)): names[0] for formula, names in table.items()}
        factors |= {float(_factor(formula)): n for n, formula in EXACT_CASE.get(kind, {}).items()}
        units = {name: f for f, name in sorted(factors.items())}
        part = source_units(rows.where(F.col("name") == kind), "source", {"recorded": units}, [({"recorded": 1, "stated": -1}, 1.0)], tolerance)
        out = part if out is None else out.unionAll(part)
    return out.select("source.name", "source.unit", F.col("units")["recorded"].alias("meant"), "rms", "is_unique")


def source_units(df: DataFrame, source: str, columns: Mapping[str, Mapping[str, float]], identities: Sequence[tuple[Mapping[str, int], float]], tolerance: float = 0.02) -> DataFrame:
    """The units in which each source records its columns, from identities between the columns.

    ``columns``: per column the candidate units with their factor to the common one. An identity is
    as in :func:`choose_readings`. A row's log residual is that of the raw numbers plus a shift that
    depends on the units alone, so the sum of squares over all rows of a source follows for every
    combination from three partial sums per identity; no row is repeated per combination.

    Gives per source one row: ``units`` (column -> unit), ``rms`` (root mean square log residual)
    and ``is_unique``, false where another combination fits as well within ``tolerance``. Rows with
    a null, zero or negative number in an identity are left out of it; a source without any usable
    row has null ``rms`` and is not unique. A null source is a source of its own.
    """
    names = list(columns)
    logs = []
    for i, (powers_, k) in enumerate(identities):
        good = None
        r = F.lit(-math.log(k))
        for c, e in powers_.items():
            ok = F.col(c) > 0
            good = ok if good is None else good & ok
            r = r + F.lit(float(e)) * F.ln(F.when(ok, F.col(c).cast("double")))
        logs.append((f"__r{i}", F.when(good, r)))
    sums = (
        df.select(source, *[e.alias(n) for n, e in logs])
        .groupBy(source)
        .agg(*[f for n, _ in logs for f in (F.count(n).alias(f"{n}n"), F.sum(n).alias(f"{n}s"), F.sum(F.col(n) * F.col(n)).alias(f"{n}q"))])
    )
    combos = []
    for combo in itertools.product(*[list(columns[c]) for c in names]):
        cost = F.lit(0.0)
        for i, (powers_, _) in enumerate(identities):
            shift = sum(e * math.log(columns[c][combo[names.index(c)]]) for c, e in powers_.items() if c in columns)
            n, s, q = (F.col(f"__r{i}{x}") for x in "nsq")
            cost = cost + F.coalesce(q + 2 * shift * s + shift * shift * n, F.lit(0.0))
        combos.append(F.struct(F.greatest(cost, F.lit(0.0)).alias("cost"), F.create_map(*[F.lit(x) for c, u in zip(names, combo) for x in (c, u)]).alias("units"), F.lit(len(combos)).alias("ix")))
    rows = sum((F.col(f"__r{i}n") for i in range(len(identities))), F.lit(0))
    ranked = F.array_sort(F.array(*combos), lambda a, b: F.when(a["cost"] < b["cost"], -1).when(a["cost"] > b["cost"], 1).otherwise(a["ix"] - b["ix"]))
    got = sums.select(source, rows.alias("__n"), ranked.alias("__c"))
    best = F.col("__c")[0]
    return got.select(
        source,
        best["units"].alias("units"),
        F.when(F.col("__n") > 0, F.sqrt(best["cost"] / F.col("__n"))).alias("rms"),
        ((F.col("__n") > 0) & ~F.exists(F.slice("__c", 2, max(1, len(combos))), lambda x: x["cost"] <= best["cost"] + F.lit(tolerance**2) * F.col("__n"))).alias("is_unique"),
    )
