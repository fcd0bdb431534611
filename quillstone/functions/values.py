"""How values compare, count as true, round, sort and print, as Column expressions.

The query language (table queries) and the view language differ; functions of views begin with view_.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# A month is 30 days and a year 365 in a query's durations.
UNIT_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS, "week": 7 * DAY_MS, "month": 30 * DAY_MS, "year": 365 * DAY_MS}
UNIT_NAMES = {"ms": "millisecond", "s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "wk": "week", "mo": "month", "y": "year", "yr": "year"}
#: Order of types in comparisons of mixed values.
RANKS = ("null", "boolean", "number", "string", "date", "duration", "link", "array", "object")


# Truth and comparison ---------------------------------------------------------------------------------------------


def truthy(c: Column, kind: str) -> Column:
    """Never null: empty text, empty lists, zero and null are false."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "number":
        return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))
    if kind == "string":
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def equal(a: Column, b: Column) -> Column:
    """Total: null equals null."""
    return a.eqNullSafe(b)


def less(a: Column, b: Column) -> Column:
    """False when a side is null."""
    return F.coalesce(a < b, F.lit(False))


def at_most(a: Column, b: Column) -> Column:
    return F.coalesce(a <= b, F.lit(False))


def tagged(c: Column, kind: str) -> Column:
    """A value of any type as a struct that orders and groups across types; null has rank 0 and comes first."""
    n = F.when(c.isNotNull(), F.lit(RANKS.index(kind))).otherwise(F.lit(0))
    empty = {"b": "boolean", "n": "double", "s": "string", "t": "timestamp"}
    slot = {"boolean": "b", "number": "n", "string": "s", "link": "s", "date": "t", "duration": "n"}[kind]
    return F.struct(n.alias("rank"), *[(c.cast(t) if k == slot else F.lit(None).cast(t)).alias(k) for k, t in empty.items()])


def any_of_kind(*choices: tuple[Column, Column, str]) -> Column:
    """The tagged value of the first (condition, value, kind) that holds."""
    none = tagged(F.lit(None).cast("string"), "string")
    return reduce(lambda rest, x: F.when(x[0], tagged(x[1], x[2])).otherwise(rest), reversed(choices), none)


def from_text(text: Column) -> Column:
    """The tagged value that raw field text stands for: empty is null, then true/false, numbers without leading zeros, dates, text."""
    trimmed = F.trim(text)
    number = trimmed.rlike(r"^-?\d+(\.\d+)?$") & ~trimmed.rlike(r"^0\d")
    day = trimmed.rlike(r"^\d{4}-\d\d(-\d\d)?(T\d\d:\d\d(:\d\d)?)?$")
    full_day = F.when(F.length(trimmed) == 7, F.concat(trimmed, F.lit("-01"))).otherwise(F.replace(trimmed, F.lit("T"), F.lit(" ")))
    return any_of_kind(
        (trimmed == "", F.lit(None).cast("string"), "string"),
        (F.lower(trimmed).isin("true", "false"), F.lower(trimmed) == "true", "boolean"),
        (number, trimmed.try_cast("double"), "number"),
        (day & full_day.try_cast("timestamp").isNotNull(), full_day.try_cast("timestamp"), "date"),
        (trimmed.isNotNull(), trimmed, "string"),
    )


# Numbers ----------------------------------------------------------------------------------------------------------


def half_up(x: Column, digits: int = 0) -> Column:
    """Ties toward positive infinity."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def divide(a: Column, b: Column) -> Column:
    """Null for a zero divisor."""
    return F.try_divide(a, b)


def remainder(a: Column, b: Column) -> Column:
    return F.try_mod(a, b) if hasattr(F, "try_mod") else F.when(b != 0, a % b)


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"-?\d+(\.\d+)?", 0).try_cast("double")


# Text -------------------------------------------------------------------------------------------------------------


def _folding() -> tuple[str, str]:
    """Letters that are a base letter and marks, with that letter; Hangul syllables stay, as equal ones are equal either way."""
    pairs = {"đ": "d"}
    for code in range(0xC0, 0x10000):
        c = chr(code)
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(unicodedata.category(m).startswith("M") for m in marks):
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _folding()


def fold(s: Column) -> Column:
    """Small letters without accents, in every script; combining marks are dropped."""
    return F.regexp_replace(F.translate(F.lower(s), ACCENTED, PLAIN), r"\p{M}", "")


def natural_key(s: Column) -> Column:
    """A key that sorts text without regard to case and accents, and runs of digits by their number: its length, then its digits."""
    parts = F.regexp_extract_all(fold(s), F.lit(r"\d+|\D+"), F.lit(0))

    def numbered(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), numbered(p)).otherwise(p)), "")


def contains(hay: Column, needle: Column, kind: str = "string") -> Column:
    """Text in text, or text in any element of a list."""
    found = F.exists(hay, lambda x: x.contains(needle)) if kind == "array" else hay.contains(needle)
    return F.coalesce(found, F.lit(False))


def icontains(hay: Column, needle: Column, kind: str = "string") -> Column:
    found = F.exists(hay, lambda x: F.lower(x).contains(F.lower(needle))) if kind == "array" else F.lower(hay).contains(F.lower(needle))
    return F.coalesce(found, F.lit(False))


def econtains(hay: Column, needle: Column, kind: str = "string") -> Column:
    """An element equal to the needle; of a text, the text itself in it."""
    found = F.exists(hay, lambda x: x.eqNullSafe(needle)) if kind == "array" else hay.contains(needle)
    return F.coalesce(found, F.lit(False))


def pattern_ok(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def regexmatch(pattern: str, text: Column) -> Column:
    """The whole text; false for a pattern that is none."""
    return F.coalesce(text.rlike(f"^(?:{pattern})$"), F.lit(False)) if pattern_ok(pattern) else F.lit(False)


def regextest(pattern: str, text: Column) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False)) if pattern_ok(pattern) else F.lit(False)


def pad_left(s: Column, n: int, fill: str = " ") -> Column:
    """Never shortens."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill))


def pad_right(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill))


def truncate(s: Column, n: int, suffix: str = "...") -> Column:
    """A longer text's first n characters, and the suffix after them."""
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit(suffix)))


def title(s: Column) -> Column:
    """First letters of words in capitals; the rest stays, white space of any kind included."""
    parts = F.regexp_extract_all(s, F.lit(r"(\s|\S+)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


# Dates and durations ----------------------------------------------------------------------------------------------


def duration_ms(text: str) -> int:
    """Milliseconds of text such as '7 days' or '1h 30m'."""
    total, found = 0.0, False
    for n, unit in re.findall(r"(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)", text):
        name = UNIT_NAMES.get(unit.lower(), unit.lower().rstrip("s"))
        if name not in UNIT_MS:
            raise ValueError(f"no such unit: {unit}")
        total, found = total + float(n) * UNIT_MS[name], True
    if not found:
        raise ValueError(f"no duration: {text}")
    return round(total)


def plus_ms(t: Column, ms: Column | int) -> Column:
    ms = F.lit(ms) if isinstance(ms, int) else ms
    return F.timestamp_millis(F.unix_millis(t.cast("timestamp")) + ms)


def between_ms(a: Column, b: Column) -> Column:
    """a - b."""
    return F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))


def view_plus(t: Column, months: int = 0, ms: int = 0) -> Column:
    """Calendar months, clamped to the end of the month, then milliseconds."""
    t = t.cast("timestamp")
    moved = plus_ms(F.add_months(t.cast("date"), months).cast("timestamp"), between_ms(t, F.date_trunc("day", t)))
    return plus_ms(moved, ms) if ms else moved


def date_word(word: str, now: Column) -> Column:
    """today, tomorrow, yesterday, now, and starts and ends of the week (from Monday), month and year."""
    day = F.date_trunc("day", now)
    last_moment = lambda start, months, days: plus_ms((F.add_months(start.cast("date"), months) if months else F.date_add(start.cast("date"), days)).cast("timestamp"), -1)
    week, month, year = (F.date_trunc(u, now) for u in ("week", "month", "year"))
    words = {
        "now": now, "today": day, "tomorrow": plus_ms(day, DAY_MS), "yesterday": plus_ms(day, -DAY_MS),
        "sow": week, "eow": last_moment(week, 0, 7), "som": month, "eom": last_moment(month, 1, 0), "soy": year, "eoy": last_moment(year, 12, 0),
    }
    return words[word]


def date_part(t: Column, part: str) -> Column:
    if part == "weekday":
        return F.weekday(t) + 1
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "week": F.weekofyear}[part](t)


def _tokens(pattern: str, table: dict[str, str]) -> str:
    """A Java pattern from one of other tokens; longer tokens first, other letters quoted."""
    names = sorted(table, key=len, reverse=True)
    out = []
    for m in re.finditer("|".join(map(re.escape, names)) + r"|\[([^\]]*)\]|'([^']*)'|.", pattern, re.S):
        s = m[0]
        quoted = m[1] if m[1] is not None else m[2]
        out.append("'" + quoted.replace("'", "''") + "'" if quoted is not None else table.get(s, f"'{s}'" if s.isalpha() else s))
    return "".join(out)


# Format tokens of queries and of views, as Java's.
QUERY_TOKENS = {t: t for t in ("yyyy", "yy", "MMMM", "MMM", "MM", "M", "dd", "d", "HH", "H", "hh", "h", "mm", "m", "ss", "s", "SSS", "a", "EEEE", "EEE")} | {"cccc": "EEEE", "ccc": "EEE", "LLLL": "MMMM", "LLL": "MMM", "LL": "MM", "L": "M"}
VIEW_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d", "dddd": "EEEE", "ddd": "EEE", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "SSS": "SSS", "A": "a", "a": "a"}


def dateformat(t: Column, pattern: str) -> Column:
    return F.date_format(t, _tokens(pattern, QUERY_TOKENS))


def view_format(t: Column, pattern: str) -> Column:
    return F.date_format(t, _tokens(pattern, VIEW_TOKENS))


def relative(t: Column, now: Column) -> Column:
    """How long ago or ahead, in the largest unit that fits, from minutes to years."""
    ms = between_ms(t, now)
    size, out = F.abs(ms), F.lit("just now")
    for unit in ("minute", "hour", "day", "week", "month", "year"):
        n = half_up(size / UNIT_MS[unit]).cast("long")
        words = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""))
        out = F.when(size >= UNIT_MS[unit], F.when(ms < 0, F.concat(words, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), words))).otherwise(out)
    return out


# Lists ------------------------------------------------------------------------------------------------------------


def list_sum(l: Column) -> Column:
    """Null for no values; nulls are left out."""
    full = F.filter(l, lambda x: x.isNotNull())
    return F.when(F.size(full) > 0, F.aggregate(full, F.lit(0.0), lambda a, x: a + x))


def view_list_sum(l: Column) -> Column:
    """0 for no values."""
    return F.coalesce(list_sum(l), F.lit(0.0))


def list_mean(l: Column) -> Column:
    full = F.filter(l, lambda x: x.isNotNull())
    return F.try_divide(list_sum(l), F.size(full))


def list_slice(l: Column, start: int, end: int | None = None) -> Column:
    """From start up to, not including, end; negatives count from the end."""
    n = F.size(l)
    at = lambda k: F.greatest(n + k, F.lit(0)) if k < 0 else F.least(F.lit(k), n)
    first, last = at(start), n if end is None else at(end)
    return F.slice(l, first + 1, F.greatest(last - first, F.lit(0)))


def item(l: Column, i: int) -> Column:
    """From 0; negatives from the end; null outside."""
    return F.try_element_at(l, F.lit(i + 1 if i >= 0 else i))


def unnest(v: Column) -> Column:
    """A row for each element: an empty list gives none, null gives one."""
    return F.explode(F.coalesce(v, F.array(F.lit(None))))


def shown(c: Column, kind: str) -> Column:
    """As text: null is empty, whole numbers have no decimals, lists are joined by a comma."""
    if kind == "number":
        c = F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif kind == "array":
        c = F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ", ")
    elif kind == "date":
        c = F.when(c == F.date_trunc("day", c), F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm"))
    return F.coalesce(c.cast("string"), F.lit(""))


def contains_all(hay: Column, needles: list[Column], kind: str = "string") -> Column:
    return reduce(lambda a, b: a & b, [contains(hay, n, kind) for n in needles], F.lit(True))


def contains_any(hay: Column, needles: list[Column], kind: str = "string") -> Column:
    return reduce(lambda a, b: a | b, [contains(hay, n, kind) for n in needles], F.lit(False))


def index_of(l: Column, value: Column) -> Column:
    """From 0; -1 if it is not there."""
    return F.coalesce(F.array_position(l, value) - 1, F.lit(-1).cast("long"))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


# Texts, kinds and links -------------------------------------------------------------------------------------------


def text_slice(s: Column, start: int, end: int | None = None) -> Column:
    """Characters from start up to, not including, end; negatives count from the end."""
    n = F.length(s)
    at = lambda k: F.greatest(n + k, F.lit(0)) if k < 0 else F.least(F.lit(k), n)
    first, last = at(start), n if end is None else at(end)
    return F.substr(s, first + 1, F.greatest(last - first, F.lit(0)))


def is_empty(c: Column, kind: str) -> Column:
    """Null, an empty text, an empty list or an empty object."""
    if kind == "string":
        return F.coalesce(c == "", F.lit(True))
    if kind in ("array", "object"):
        return F.coalesce(F.size(c) <= 0, F.lit(True))
    return c.isNull()


LINK_TYPE = "struct<path:string,subpath:string,display:string>"


def kind_name(c: Column) -> Column:
    """null, boolean, number, string, date, duration (an interval), link (see link()), array or object, by the type of the column."""
    t = F.typeof(c)
    named = F.when(t.isin("tinyint", "smallint", "int", "bigint", "float", "double") | t.startswith("decimal"), "number")
    named = named.when(t.isin("date", "timestamp", "timestamp_ntz"), "date").when(t.startswith("interval"), "duration").when(t == LINK_TYPE, "link")
    named = named.when(t.startswith("array"), "array").when(t.startswith("map") | t.startswith("struct"), "object")
    return F.when(c.isNull(), "null").otherwise(named.otherwise(t))


def link(target: Column, display: Column | None = None) -> Column:
    """struct<path, subpath, display> of a link's target; what follows a # is the subpath, null if there is none."""
    sub = F.when(F.contains(target, F.lit("#")), F.substr(target, F.locate("#", target) + 1))
    return F.struct(F.substring_index(target, "#", 1).alias("path"), sub.alias("subpath"), (F.lit(None).cast("string") if display is None else display).alias("display"))


def link_date(path: Column) -> Column:
    """The first ISO date in a path."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(path, r"(\d{4}-\d\d-\d\d)", 1), F.lit("")), F.lit("yyyy-MM-dd"))


def duration_part(ms: Column, unit: str) -> Column:
    """A duration in a unit, with its fraction."""
    return ms / UNIT_MS[UNIT_NAMES.get(unit, unit.rstrip("s"))]


def strip_time(t: Column) -> Column:
    """The start of the day."""
    return F.date_trunc("day", t)


def extreme(values: list[Column], kinds: list[str], greatest: bool = False) -> Column:
    """The tagged least or greatest of values of any types, in the order of mixed values; nulls are left out, null if none is left."""
    full = F.filter(F.array(*[tagged(v, k) for v, k in zip(values, kinds, strict=True)]), lambda x: x["rank"] > 0)
    return F.array_max(full) if greatest else F.array_min(full)


def as_list(c: Column, kind: str) -> Column:
    """A list stays; anything else becomes a list of it, null an empty one."""
    return F.coalesce(c, F.array()) if kind == "array" else F.filter(F.array(c), lambda x: x.isNotNull())


def is_type(c: Column, name: str) -> Column:
    return kind_name(c) == name.strip().lower()


def view_least(*numbers: Column) -> Column:
    """The least number; nulls are left out."""
    return F.least(*numbers) if len(numbers) > 1 else numbers[0]


def view_greatest(*numbers: Column) -> Column:
    return F.greatest(*numbers) if len(numbers) > 1 else numbers[0]


def as_number(c: Column, kind: str) -> Column:
    """Dates in milliseconds, true as 1, text if it is a number, else null."""
    if kind == "date":
        return F.unix_millis(c.cast("timestamp")).cast("double")
    if kind == "boolean":
        return c.cast("int").cast("double")
    return F.trim(c).try_cast("double") if kind == "string" else c.cast("double")


def escape_html(s: Column) -> Column:
    """The five characters that need it."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    return s


def has_property(fields: Column, name: str) -> Column:
    """Whether a map of fields has a name; case does not matter."""
    return F.coalesce(F.exists(F.map_keys(fields), lambda k: F.lower(k) == name.lower()), F.lit(False))


def normal_path(path: Column) -> Column:
    """Without `.` and `..`."""
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.isin("", "."), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
