"""Scalar functions on Columns: numbers, text, dates and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import COLUMNS, Columns

# Fixed values.
RISK_BANDS = ((80, "critical", "#ef4444"), (60, "high", "#f97316"), (40, "medium", "#eab308"))
LOW_BAND = ("low", "#10b981")
FESTIVAL_MONTHS = (10, 11, 1)
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
               "November", "December")
EARTH_RADIUS_KM = 6371.0
STATIONS_PER_UNIT = 47
NOT_AVAILABLE = "N/A"
# End of fixed values.


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(value: Column | str, digits: int) -> Column:
    """Half-up rounding of the value a double stands for.

    Arithmetic noise is taken off first: 0.89374999999999982 means 0.89375 and
    rounds to 0.8938.
    """
    return F.round(F.round(col(value), digits + 5), digits)


def seasonal_columns(present: Sequence[str], cols: Columns = COLUMNS) -> dict[str, Column]:
    """F1. Sine and cosine of month and quarter, for those of the two that are present."""
    out: dict[str, Column] = {}
    for name, period, label in ((cols.month, 12, "month"), (cols.quarter, 4, "quarter")):
        if name in present:
            angle = 2 * F.pi() * F.col(name) / F.lit(period)
            out[f"{label}_sin"], out[f"{label}_cos"] = F.sin(angle), F.cos(angle)
    return out


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """F2. Great-circle distance in km, two decimals."""
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return rounded(2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))), 2)


def rate_100k(count: Column | str, population: Column | str) -> Column:
    """F3. Count per 100,000 people, NULL without a positive population."""
    return F.when(col(population) > 0, col(count) / col(population) * 100000)


def rate_100k_smoothed(count: Column | str, population: Column | str) -> Column:
    """F3, panel form: a tiny constant in the denominator instead of a guard."""
    return col(count) / (col(population) + F.lit(1e-6)) * 100000


def clamp(value: Column | str, low: float, high: float) -> Column:
    """C15. Value cut to [low, high]; NULL stays NULL."""
    v = col(value)
    return F.when(v.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v.cast("double"))))


def first_of(*values: Column | str) -> Column:
    """C16, column form: the first non-null value."""
    return F.coalesce(*map(col, values))


def risk_band(score: Column | str) -> Column:
    """F7. critical / high / medium / low."""
    return _banded(score, 1, LOW_BAND[0])


def risk_colour(score: Column | str) -> Column:
    """F7. The colour code of the band."""
    return _banded(score, 2, LOW_BAND[1])


def _banded(score: Column | str, field: int, low: str) -> Column:
    s, out = col(score), None
    for band in RISK_BANDS:
        out = F.when(s >= band[0], band[field]) if out is None else out.when(s >= band[0], band[field])
    return F.when(s.isNotNull(), out.otherwise(low))


def marker_size(score: Column | str) -> Column:
    """F7. Radius of a map marker, 6 to 16."""
    return 6 + F.coalesce(col(score), F.lit(0.0)) / 10


def display_number(value: Column | str, decimals: int = 0) -> Column:
    """F8. Thousands separators, 'N/A' for NULL."""
    return F.coalesce(F.format_number(col(value), decimals), F.lit(NOT_AVAILABLE))


def display_percent(value: Column | str, decimals: int = 1) -> Column:
    """F8. Fixed decimals and a percent sign, 'N/A' for NULL."""
    text = F.format_string(f"%.{decimals}f%%", col(value).cast("double"))
    return F.when(col(value).isNull(), F.lit(NOT_AVAILABLE)).otherwise(text)


def display_compact(value: Column | str) -> Column:
    """F8. One decimal and K / M / B, 'N/A' for NULL."""
    v = col(value).cast("double")
    size = F.abs(v)
    out = (
        F.when(size >= 1e9, F.format_string("%.1fB", v / 1e9))
        .when(size >= 1e6, F.format_string("%.1fM", v / 1e6))
        .when(size >= 1e3, F.format_string("%.1fK", v / 1e3))
        .otherwise(F.format_string("%.0f", v))
    )
    return F.when(v.isNull(), F.lit(NOT_AVAILABLE)).otherwise(out)


def age_text(then: Column | str, as_of: Column) -> Column:
    """F9. '42s ago' / 'm' / 'h' / 'd', whole units rounded down."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(col(then).cast("timestamp"))
    number = (
        F.when(seconds < 60, seconds).when(seconds < 3600, F.floor(seconds / 60))
        .when(seconds < 86400, F.floor(seconds / 3600)).otherwise(F.floor(seconds / 86400))
    )
    unit = F.when(seconds < 60, "s").when(seconds < 3600, "m").when(seconds < 86400, "h").otherwise("d")
    return F.concat(number.cast("string"), unit, F.lit(" ago"))


def safe_name(title: Column | str, length: int = 50) -> Column:
    """F10. Letters, digits and ``._-`` only, cut to ``length``."""
    return F.substring(F.regexp_replace(col(title), r"[^\p{L}\p{N}._-]", ""), 1, length)


def incident_id(year: Column | str, number: Column | str, prefix: str = "INC") -> Column:
    """F11. ``<prefix>-<year>-<8 digits>``."""
    return F.concat_ws("-", F.lit(prefix), col(year).cast("string"), F.lpad(col(number).cast("string"), 8, "0"))


def station_id(state: Column | str, number: Column | str) -> Column:
    """F11. ``PS-<3 letters>-<3 digits>``, numbers wrap after 47."""
    place = F.upper(F.substring(col(state), 1, 3))
    return F.concat_ws("-", F.lit("PS"), place,
                       F.lpad((F.pmod(col(number), F.lit(STATIONS_PER_UNIT)) + 1).cast("string"), 3, "0"))


def admin_code(state: Column | str, unit: Column | str) -> Column:
    """F11. Two letters of the state, three of the unit (or of the state when there is no unit)."""
    place = F.coalesce(F.nullif(col(unit), F.lit("")), col(state))
    return F.concat_ws("-", F.upper(F.substring(col(state), 1, 2)), F.upper(F.substring(place, 1, 3)))


def month_name(month: Column | str) -> Column:
    """A19. Number 1..12 to the English name."""
    return F.element_at(F.array(*map(F.lit, MONTH_NAMES)), col(month).cast("int"))


def calendar_flags(date: Column | str) -> dict[str, Column]:
    """C8. Weekend, festival month, quarter, ISO week and short day name of a date."""
    d = col(date)
    return {
        "is_weekend": F.weekday(d) >= 5,
        "is_festival_month": F.month(d).isin(*FESTIVAL_MONTHS),
        "quarter": F.quarter(d),
        "week": F.weekofyear(d),
        "day_of_week": F.date_format(d, "E"),
    }


def clamp_day(month: Column | str, day: Column | str) -> Column:
    """C8. Day of month cut to the month's length, February always 28."""
    m = col(month)
    last = F.when(m == 2, 28).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.least(col(day), last)


def hour_flags(ts: Column | str) -> dict[str, Column]:
    """C9. Part of the day, night and office-hour flags of a timestamp."""
    h = F.hour(col(ts))
    part = (
        F.when(h < 6, "Night").when(h < 12, "Morning").when(h < 17, "Afternoon").when(h < 21, "Evening")
        .otherwise("Night")
    )
    return {"time_of_day": F.when(h.isNotNull(), part), "is_night": (h < 6) | (h >= 22),
            "is_office_hour": h.between(9, 18)}


def client_ip(forwarded: Column | str, host: Column | str) -> Column:
    """C20. First entry of the forwarding header, else the peer address, else 'unknown'."""
    first = F.trim(F.split_part(F.coalesce(col(forwarded), F.lit("")), F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), col(host), F.lit("unknown"))


def lookup_map(values: Mapping[str, float]) -> Column:
    """A literal map for fixed lookup tables."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
