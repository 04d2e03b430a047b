"""Mixed timestamp texts to one moment in UTC.

Each text is reduced to a shape mask (digit, letter, space, other characters as they stand).
A distinct mask is matched to a parser once; the parser knows at which positions the fields
stand, so all texts of a mask are cut and converted together as arrays. Wall times go through
a versioned table of zone transitions that is made on the driver from the JVM's rules.

Defined results: null, blank and unreadable texts, and impossible dates or times, give null; texts
may be any length, digits beyond the microsecond are cut off. A wall time that occurs twice means the
first one, a skipped one moves forward by the skipped time. A weekday must be a weekday's name, but
needn't be that of the date. Repeated rows give repeated results. The transitions come from the JVM's
rules, so the session must have a JVM of its own (not Spark Connect).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

WIDE = 64  # longer texts are read one by one, not as part of an array
US = 1_000_000
CYCLE_YEARS, CYCLE_S = 400, 146_097 * 86_400  # after so many years days, weekdays and recurring rules repeat

# Minutes east of Greenwich of the zone letters (Atlantic, Newfoundland, Eastern, Greenwich).
ZONE_MINUTES = {
    "ADT": -180, "AST": -240, "EDT": -240, "EST": -300, "GMT": 0, "NDT": -150, "NST": -210, "UT": 0, "UTC": 0, "Z": 0,
    "HAA": -180, "HNA": -240, "HAE": -240, "HNE": -300, "HAT": -150, "HNT": -210,
}

# Month names, English and French, and their short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
    "janv": 1, "févr": 2, "fév": 2, "avr": 4, "juil": 7, "déc": 12, "aout": 8, "fevrier": 2, "decembre": 12,
}
ORDINALS = {"st", "nd", "rd", "th", "er"}
# Weekday names, English and French, and their short forms.
WEEKDAYS = {
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun",
    "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche",
    "lun", "mar", "mer", "jeu", "ven", "sam", "dim",
}

_WEEKDAY = r"(?:(?P<w>a{2,9})\.?,? )?"
_DATES = (
    r"(?P<Y>dddd)-(?P<m>dd?)-(?P<D>dd?)",
    r"(?P<Y>dddd)/(?P<m>dd?)/(?P<D>dd?)",
    r"(?P<m>dd?)/(?P<D>dd?)/(?P<Y>dddd|dd)",
    r"(?P<D>dd?)\.(?P<m>dd?)\.(?P<Y>dddd|dd)",
    _WEEKDAY + r"(?P<D>dd?)(?P<o>aa)?[ -](?P<B>a{3,9})\.?,?[ -](?P<Y>dddd|dd)",
    _WEEKDAY + r"(?P<B>a{3,9})\.? (?P<D>dd?)(?P<o>aa)?,? (?P<Y>dddd)",
    r"(?P<Y>dddd)(?P<m>dd)(?P<D>dd)",
)
_ZONE = r"(?: ?(?P<z>a{1,5}(?!a)|(?P<zs>[+-])(?P<zh>dd)(?::?(?P<zm>dd))?))?"
_CLOCK = r"(?:(?P<t>a)|,? )(?P<H>dd?)(?::|(?P<h> ?a ?))(?P<M>dd)(?::(?P<S>dd)(?:[.,](?P<f>d+))?)?(?: ?(?P<p>aa(?!a)|a\.a\.))?" + _ZONE
_COMPACT = r"(?:(?P<t>a)| )(?P<H>dd)(?P<M>dd)(?:(?P<S>dd))?" + _ZONE
_SHAPES = [re.compile(d + r"(?:" + _CLOCK + r")?") for d in _DATES] + [re.compile(_DATES[-1] + _COMPACT)]
_UNIX = {10: US, 13: 1000}


@dataclass(frozen=True)
class ZoneTable:
    """Wall-clock switch moments (seconds, as if UTC) and the offset in force from each; offsets[0] is before all.

    The table reaches `until` (seconds); what is later is looked up whole cycles of 400 years earlier,
    where the recurring rules give the same.
    """

    zone: str
    version: str
    switches: np.ndarray
    offsets: np.ndarray
    until: int

    def _within(self, seconds: np.ndarray) -> np.ndarray:
        return seconds - np.maximum(0, -((self.until - seconds) // CYCLE_S)) * CYCLE_S

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """Wall seconds to UTC seconds: first of two, and forward over a gap."""
        return wall - self.offsets[np.searchsorted(self.switches, self._within(wall), side="right")]

    def to_wall(self, utc: np.ndarray) -> np.ndarray:
        # A switch stands at the later of the two readings of its wall clock.
        moments = self.switches - np.maximum(self.offsets[1:], self.offsets[:-1])
        return utc + self.offsets[np.searchsorted(moments, self._within(utc), side="right")]


def _seconds(offset: str) -> int:
    """Seconds east of Greenwich of an offset as Java writes it."""
    if offset == "Z":
        return 0
    parts = [int(x) for x in offset[1:].split(":")]
    return (-1 if offset[0] == "-" else 1) * sum(x * k for x, k in zip(parts, (3600, 60, 1), strict=False))


_TABLES: dict[tuple[str, str | None], ZoneTable] = {}


def zone_table(spark: SparkSession, zone: str = "America/Halifax", version: str | None = None) -> ZoneTable:
    """The transitions of a zone under one version of the rules (the newest known unless named)."""
    if (zone, version) in _TABLES:
        return _TABLES[zone, version]
    jvm = spark._jvm
    versions = jvm.java.time.zone.ZoneRulesProvider.getVersions(zone)
    name = version or versions.lastKey()
    rules = versions.get(name)
    if rules is None:
        raise ValueError(f"no rules of version {name} for {zone}")
    known = rules.getTransitions().toString()
    last = max(map(int, re.findall(r" at (\d{4})-", known)), default=1970)
    for rule in rules.getTransitionRules():
        known += "".join(rule.createTransition(year).toString() for year in range(last + 1, last + CYCLE_YEARS + 2))
    epoch = datetime(1970, 1, 1)
    until = int((datetime(last + CYCLE_YEARS + 1, 7, 1) - epoch).total_seconds())  # more than a cycle after the last listed one
    steps = sorted((datetime.fromisoformat(m[1]) - epoch, _seconds(m[2]), _seconds(m[3])) for m in re.finditer(r" at (\d{4}[\dT:-]+\d)([+-][\d:]+|Z) to ([+-][\d:]+|Z)\]", known))
    # The text has the wall clock before the switch; a switch is kept at the later of its two readings.
    switches = [int(at.total_seconds()) + max(0, after - before) for at, before, after in steps]
    offsets = [steps[0][1], *(after for _, _, after in steps)] if steps else [rules.getOffset(jvm.java.time.Instant.EPOCH).getTotalSeconds()]
    _TABLES[zone, version] = out = ZoneTable(zone, name, np.array(switches, np.int64), np.array(offsets, np.int64), until)
    return out


_CLASS = np.array(["d" if "0" <= chr(i) <= "9" else "a" if chr(i).isalpha() else " " if chr(i).isspace() else chr(i) if 32 < i < 127 else "?" for i in range(0x250)]).astype("U1").view(np.uint32).astype(np.uint8)
_PLANS: dict[bytes, dict[str, tuple[int, int]] | int | None] = {}


def shape_masks(texts: np.ndarray) -> np.ndarray:
    """The masks of an array of fixed-width texts, as fixed-width bytes."""
    n, width = len(texts), texts.dtype.itemsize // 4
    codes = texts.view(np.uint32).reshape(n, width)
    classes = np.where(codes < len(_CLASS), _CLASS[np.minimum(codes, len(_CLASS) - 1)], ord("?")).astype(np.uint8)
    classes[codes == 0] = 0
    return np.ascontiguousarray(classes).view(f"S{width}").reshape(n)


def parser_of(mask: bytes) -> dict[str, tuple[int, int]] | int | None:
    """Field positions of a mask, the factor of a Unix count, or None; worked out once for a mask."""
    if mask in _PLANS:
        return _PLANS[mask]
    if len(_PLANS) > 20_000:
        _PLANS.clear()
    text, plan = mask.decode("ascii"), None
    if text.strip("d") == "" and len(text) in _UNIX:
        plan = _UNIX[len(text)]
    else:
        for shape in _SHAPES:
            if m := shape.fullmatch(text):
                plan = {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
                break
    if len(mask) <= WIDE:
        _PLANS[mask] = plan
    return plan


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    return (y * 12 + m - 1 - 1970 * 12).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _days(y, m + 1, 1) - _days(y, m, 1)


def _convert(texts: np.ndarray, plan: dict[str, tuple[int, int]] | int, zone: ZoneTable) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds in UTC of texts of one mask, and which of them are real."""
    n, width = len(texts), texts.dtype.itemsize // 4
    codes = np.ascontiguousarray(texts).view(np.uint32).reshape(n, width).astype(np.int64)

    def number(a: int, b: int) -> np.ndarray:
        return (codes[:, a:b] - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    def words(a: int, b: int) -> np.ndarray:
        return np.ascontiguousarray(codes[:, a:b].astype(np.uint32)).view(f"U{b - a}").reshape(n)

    def looked_up(name: str, known: dict[str, int], missing: int, upper: bool = False) -> np.ndarray:
        found, back = np.unique(words(*plan[name]), return_inverse=True)
        return np.array([known.get(w.upper() if upper else w.lower(), missing) for w in found], np.int64)[back]

    if isinstance(plan, int):
        return number(0, len(texts[0])) * plan, np.ones(n, bool)
    field = lambda k, default=0: number(*plan[k]) if k in plan else np.full(n, default, np.int64)
    good = np.ones(n, bool)
    y = field("Y")
    if plan["Y"][1] - plan["Y"][0] == 2:
        y = y + 2000
    m = looked_up("B", MONTHS, 0) if "B" in plan else field("m")
    d = field("D")
    if "o" in plan:
        good &= looked_up("o", dict.fromkeys(ORDINALS, 1), 0) == 1
    if "w" in plan:
        good &= looked_up("w", dict.fromkeys(WEEKDAYS, 1), 0) == 1
    if "t" in plan:
        good &= looked_up("t", {"t": 1}, 0) == 1
    if "h" in plan:
        good &= np.char.strip(np.char.lower(words(*plan["h"]))) == "h"
    hour, minute, second = field("H"), field("M"), field("S")
    greenwich = np.zeros(n, bool)
    if "p" in plan:
        half = looked_up("p", {"am": 0, "a.m.": 0, "pm": 12, "p.m.": 12}, -1)
        if "z" not in plan:  # two letters after the clock may be a zone too
            greenwich = looked_up("p", {"UT": 1}, 0, upper=True) == 1
        good &= greenwich | ((half >= 0) & (hour >= 1) & (hour <= 12))
        hour = np.where(greenwich, hour, hour % 12 + np.maximum(half, 0))
    micros = np.zeros(n, np.int64)
    if "f" in plan:
        a, b = plan["f"]
        micros = number(a, min(b, a + 6)) * 10 ** max(0, 6 - (b - a))
    good &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (hour < 24) & (minute < 60) & (second < 60)
    y, m = np.where(good, y, 2000), np.where(good, m, 1)
    good &= d <= _month_length(y, m)
    wall = _days(y, m, d) * 86_400 + hour * 3600 + minute * 60 + second
    if "zs" in plan:
        sign = np.where(codes[:, plan["zs"][0]] == ord("-"), -1, 1)
        good &= (field("zh") <= 18) & (field("zm") < 60)
        utc = wall - sign * (field("zh") * 3600 + field("zm") * 60)
    elif "z" in plan:
        minutes = looked_up("z", ZONE_MINUTES, 9999, upper=True)
        good &= minutes != 9999
        utc = wall - minutes * 60
    else:
        utc = np.where(greenwich, wall, zone.to_utc(wall))
    return utc * US + micros, good


def utc_micros(texts: pa.Array | pa.ChunkedArray, zone: ZoneTable) -> pa.Array:
    """Microseconds since 1970-01-01 00:00 UTC of each text, null where it names no real moment."""
    n = len(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_trim_whitespace(texts.cast(pa.string()))
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    out, known = np.zeros(n, np.int64), np.zeros(n, bool)
    narrow = np.flatnonzero((length > 0) & (length <= WIDE))
    for rows in ([narrow] if len(narrow) else []) + [np.array([r]) for r in np.flatnonzero(length > WIDE)]:
        values = np.array(texts.take(pa.array(rows)).to_pylist(), dtype="U")
        found, back = np.unique(shape_masks(values), return_inverse=True)
        order = np.argsort(back, kind="stable")
        bounds = np.searchsorted(back[order], np.arange(len(found) + 1))
        for k, mask in enumerate(found):
            if (plan := parser_of(bytes(mask))) is None:
                continue
            here = order[bounds[k] : bounds[k + 1]]
            out[rows[here]], known[rows[here]] = _convert(values[here].astype(f"U{len(mask)}"), plan, zone)
    return pa.array(out, pa.int64(), mask=~known)


def with_utc_micros(df: DataFrame, text: str, out: str = "utc_us", zone: str = "America/Halifax") -> DataFrame:
    """The rows of df whose text names a real moment, with that moment in a further column.

    Other columns pass unchanged; a column already called `out` is replaced.
    """
    known = zone_table(df.sparkSession, zone)
    kept = [c for c in df.columns if c != out]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us = utc_micros(b.column(b.schema.get_field_index(text)), known)
            whole = pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], us], names=[*kept, out])
            yield whole.filter(us.is_valid())

    return df.mapInArrow(convert, StructType([*[df.schema[c] for c in kept], StructField(out, LongType())]))


def wall_day(utc_us: str, zone: str = "America/Halifax") -> Column:
    """The calendar day in the zone of a column of moments, whatever the session's time zone."""
    return F.expr(f"to_date(convert_timezone('UTC', '{zone}', timestampadd(MICROSECOND, `{utc_us}`, TIMESTAMP_NTZ '1970-01-01 00:00:00')))")
