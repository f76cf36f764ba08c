"""Column -> Column expressions (survey §2.H). All are built-in Spark expressions: no Python UDF, so they stay
inside whole-stage codegen and push down where their inputs allow it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = "Column | str"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def text_to_double(c) -> Column:
    """Numeric text -> double, anything else -> null. The pattern check runs first so non-numeric text never reaches
    the cast (a failed cast is far more expensive than a regex test)."""
    t = col(c).cast("string")
    return F.when(t.rlike(NUMERIC_TEXT), t.try_cast("double"))


def whole_number(c) -> Column:
    """Numeric text -> its whole part as a long; anything else, and numbers beyond a long, -> null."""
    return text_to_double(c).try_cast("long")


def blank_to_null(c) -> Column:
    """Trimmed text, with '' -> null."""
    t = F.trim(col(c).cast("string"))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def code_text(c) -> Column:
    """Codes are compared trimmed and upper-cased."""
    return F.upper(F.trim(col(c).cast("string")))


# H1 -----------------------------------------------------------------------------------------------
def dep_hour(hhmm) -> Column:
    """Hour of an HHMM departure: null -> 0, then floor(HHMM / 100) clipped to 0..23."""
    raw = F.floor(F.coalesce(col(hhmm).cast("double").try_cast("long"), F.lit(0)) / 100)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(23)).cast("int")


def raw_dep_hour(hhmm) -> Column:
    """Unclipped hour, used by the cleaning report to count hours > 23."""
    return F.floor(F.coalesce(col(hhmm).cast("double").try_cast("long"), F.lit(0)) / 100)


# H2 -----------------------------------------------------------------------------------------------
def time_of_day(hour) -> Column:
    h = col(hour)
    return (F.when(h.between(5, 11), "morning").when(h.between(12, 16), "afternoon")
            .when(h.between(17, 21), "evening").otherwise("night"))


# H3 -----------------------------------------------------------------------------------------------
def season(month) -> Column:
    m = col(month)
    return (F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
            .when(m.isin(6, 7, 8), "summer").otherwise("fall"))


# H4 -----------------------------------------------------------------------------------------------
def ymd_date(year, month, day) -> Column:
    """Date from year/month/day parts; any null or invalid part (30 Feb) -> null. ANSI-safe."""
    y, m, d = (col(x).try_cast("int") for x in (year, month, day))
    leap = (y % 400 == 0) | ((y % 4 == 0) & (y % 100 != 0))
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= days), F.make_date(y, m, d))


def text_date(c) -> Column:
    """ISO text (or date) -> date; unparseable -> null."""
    return F.try_to_date(F.trim(col(c).cast("string")))


def flight_date(df_columns: list[str], flight_date_col="FLIGHT_DATE", year="YEAR", month="MONTH", day="DAY") -> Column | None:
    """The FLIGHT_DATE text when the column exists, else the Y/M/D parts; None when neither exists."""
    lower = {c.lower(): c for c in df_columns}
    if flight_date_col.lower() in lower:
        return text_date(lower[flight_date_col.lower()])
    if all(x.lower() in lower for x in (year, month, day)):
        return ymd_date(lower[year.lower()], lower[month.lower()], lower[day.lower()])
    return None


# H6 -----------------------------------------------------------------------------------------------
def route_key(origin, dest, sep: str = "-") -> Column:
    """origin sep dest; null if either side is null (the route separator is '-' everywhere)."""
    return F.concat(col(origin).cast("string"), F.lit(sep), col(dest).cast("string"))


def airline_dow(airline, dow) -> Column:
    return F.concat(col(airline).cast("string"), F.lit("_"), col(dow).cast("string"))


# H7 -----------------------------------------------------------------------------------------------
def is_delayed(delay, minutes: float = 15) -> Column:
    """1 when delay > minutes (strict), else 0 (null delay -> 0, as a pandas comparison gives False)."""
    return F.when(col(delay) > minutes, 1).otherwise(0).cast("int")


# H8 -----------------------------------------------------------------------------------------------
def clamp_hhmm(value, default: int = 1200) -> Column:
    """Parse a number (default when unparseable), clamp to 0..2359, hour 0..23, minutes 0..59."""
    raw = F.coalesce(whole_number(value), F.lit(default))
    raw = F.least(F.greatest(raw, F.lit(0)), F.lit(2359))
    hour = F.least(F.greatest(F.floor(raw / 100), F.lit(0)), F.lit(23))
    minute = F.least(F.greatest(F.pmod(raw, F.lit(100)), F.lit(0)), F.lit(59))
    return (hour * 100 + minute).cast("int")


# H9 -----------------------------------------------------------------------------------------------
def format_hhmm(value) -> Column:
    """HHMM -> 'HH:MM' (clamped 0..2359, minutes <= 59); non-numeric text passes trimmed; blank -> null."""
    text = F.trim(col(value).cast("string"))
    num = whole_number(text)
    raw = F.least(F.greatest(num, F.lit(0)), F.lit(2359))
    fmt = F.format_string("%02d:%02d", F.floor(raw / 100).cast("int"), F.least(F.pmod(raw, F.lit(100)), F.lit(59)).cast("int"))
    return F.when(num.isNotNull(), fmt).when(text != "", text)


# H10 ----------------------------------------------------------------------------------------------
def departure_sort_key(value) -> Column:
    """Number -> that number; 'H:M' digits -> H*100+M; anything else (or null) -> 9999."""
    text = F.trim(col(value).cast("string"))
    num = whole_number(text)
    # digits enough for any clock and few enough for a long
    hh = F.regexp_extract(text, r"^([0-9]{1,15}):([0-9]{1,15})$", 1)
    mm = F.regexp_extract(text, r"^([0-9]{1,15}):([0-9]{1,15})$", 2)
    clock = F.when(hh != "", hh.cast("long") * 100 + mm.cast("long"))
    return F.coalesce(num, clock, F.lit(9999)).cast("long")


# H11 ----------------------------------------------------------------------------------------------
def flight_number_text(value) -> Column:
    """Integer text of a flight number; non-numeric text trimmed; blank -> null."""
    text = F.trim(col(value).cast("string"))
    num = whole_number(text)
    return F.when(num.isNotNull(), num.cast("string")).when(text != "", text)


def flight_code(airline, number_text) -> Column:
    a, n = col(airline), col(number_text)
    return F.when(a.isNotNull() & n.isNotNull(), F.concat(a, n)).otherwise(n)


# H12 ----------------------------------------------------------------------------------------------
def date_dmy(iso) -> Column:
    return F.date_format(text_date(iso), "dd/MM/yyyy")


# H13 ----------------------------------------------------------------------------------------------
def infer_date(as_of: str, flight_date=None, year=None, month=None, day=None, dow=None) -> Column:
    """Date a request refers to, relative to ``as_of`` (no hidden clock).

    full date text; else Y+M+D; nothing -> as_of; only weekday -> next such weekday including as_of;
    month given (or as_of's month) with day -> that day (year rolls over when the month is already past);
    month without day or weekday -> day 1; month + weekday -> first such weekday of that month.
    """
    today = F.to_date(F.lit(as_of))
    none = F.lit(None)
    fd = text_date(flight_date) if flight_date is not None else none.cast("date")
    y = col(year).cast("int") if year is not None else none.cast("int")
    m = col(month).cast("int") if month is not None else none.cast("int")
    d = col(day).cast("int") if day is not None else none.cast("int")
    w = col(dow).cast("int") if dow is not None else none.cast("int")
    today_dow = F.dayofweek(today)  # Sunday=1 ... Saturday=7
    today_iso = F.pmod(today_dow + 5, F.lit(7)) + 1  # Monday=1 ... Sunday=7
    month_eff = F.coalesce(m, F.month(today))
    year_eff = F.coalesce(y, F.year(today) + F.when(month_eff < F.month(today), 1).otherwise(0))
    first = ymd_date(year_eff, month_eff, F.lit(1))
    first_iso = F.pmod(F.dayofweek(first) + 5, F.lit(7)) + 1
    return (
        F.when(fd.isNotNull(), fd)
        .when(y.isNotNull() & m.isNotNull() & d.isNotNull() & (y != 0) & (m != 0) & (d != 0), ymd_date(y, m, d))
        .when(m.isNull() & w.isNull() & d.isNull(), today)
        .when(m.isNull() & w.isNotNull(), F.date_add(today, F.pmod(w - today_iso, F.lit(7)).cast("int")))
        .when(d.isNotNull(), ymd_date(year_eff, month_eff, d))
        .when(w.isNull(), first)
        .otherwise(F.date_add(first, F.pmod(w - first_iso, F.lit(7)).cast("int")))
    )


# H15 ----------------------------------------------------------------------------------------------
def risk_level(p) -> Column:
    c = col(p)
    return F.when(c >= 0.7, "HIGH").when(c >= 0.4, "MEDIUM").when(c.isNotNull(), "LOW")


# H16 ----------------------------------------------------------------------------------------------
def delay_prediction(p, threshold: float = 0.5) -> Column:
    t = min(max(float(threshold), 0.0), 1.0)
    return F.when(col(p).isNotNull(), (col(p) >= F.lit(t)).cast("int"))


# H18 ----------------------------------------------------------------------------------------------
def round_half_up(c, digits: int) -> Column:
    """Half-up rounding done on decimals so the result does not depend on binary float noise."""
    return F.round(col(c).cast("decimal(38,9)"), digits).cast("double")


def kmh(ms) -> Column:
    return F.round(col(ms).cast("decimal(38,9)") * F.lit(3.6).cast("decimal(4,1)"), 1).cast("double")


def feet(m) -> Column:
    return F.round(col(m).cast("decimal(38,9)") * F.lit("3.28084").cast("decimal(10,5)"), 0).cast("double")
