"""PII: format-preserving Feistel pseudonyms. Native: DataFrame functions only.

Validated numbers (payment cards by their check digit, IPv4 addresses by octet range, North American and international
telephone numbers, US social security numbers of all areas that can be assigned, IBAN by mod 97) and dates (ISO, day-first,
and month-first where the day is over 12 and so can't be a month; real calendar days of 1900 to 2099) are permuted within their own format under a key. A permutation is one-to-one, so equal
values stay linked across documents and different ones stay apart, and who has the key can undo it (`restore=True`).
Mail addresses and secrets are not numbers: a keyed digest in the same shape replaces them and keeps equal values linked.
Lookalikes that fail validation stay as they are.

Defined results: a null text stays null with zero counts; an empty text stays empty; every occurrence counts; an empty
table gives no rows; other columns pass through, and n_chars, where there is one, follows the new text.
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.values import let
from quillstone.llm.common import free_names, read

#: Spark setting with the secret key of a deployment. Without it the registered query and the pipeline use the demonstration key
#: on a local master, which is public: whoever has it can undo their pseudonyms. On any other they make a key of the session.
KEY_SETTING, DEMO_KEY = "spark.quillstone.pseudonyms.key", "quillstone-demonstration-key"
ROUNDS = 8

# Formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE_ISO = r"(?<![\d-])\d{4}-\d\d-\d\d(?![\d-])"
DATE_DAY_FIRST = r"(?<![\d./])\d\d([./])\d\d\1\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])"
#: The usual form, or groups of one to four digits with an area code in brackets or none.
PHONE = r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){2,4})(?!\d)"
PHONE_US = r"(?<![\d+])(?:\([2-9]\d\d\)[ .-]?|\(?[2-9]\d\d\)?[ .-])[2-9]\d\d[ .-]\d{4}(?!\d)"
#: Digit groups, as many as there are. Possessive: Java's matcher goes one call deeper for each group of a repetition that it may
#: take back, and a page of a few thousand numbers overflows the stack, which ends the executor.
GROUPS = r"\d++(?:[ -]\d++)*+"
#: A maximal run of digit groups that is long enough for a card, and the cards that may begin at any group of it.
RUN = rf"(?<!\d)(?=(?:\d[ -]?){{13}}){GROUPS}"
CARD_USUAL = r"\d{4}(?:(?:[ -]\d{4}){3}|[ -]\d{6}[ -]\d{5})"
CARD_GROUPS = [r"\d{13,19}", CARD_USUAL, *[rf"\d{{3,7}}(?:[ -]\d{{3,7}}){{{k}}}[ -]\d{{1,7}}" for k in range(1, 5)]]
IBAN = r"(?<![A-Z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"
ACCESS_KEY = r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"
SECRET = r"(?i:(?:password|passwd|token|secret|api[_-]?key))\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9_+/.~-]{8,}"
PATTERN = "|".join([SECRET, EMAIL, ACCESS_KEY, IPV4, DATE_ISO, DATE_DAY_FIRST.replace(r"([./])", r"(?:[./])").replace(r"\1", "[./]"), SSN, PHONE, PHONE_US, IBAN])
#: Runs outside of other values.
RUNS = "|".join([SECRET, EMAIL, ACCESS_KEY, IPV4, IBAN, RUN])

#: What every value has one of; texts without it are passed on as they are.
GATE = r"[0-9@=:]|AKIA|ASIA"

KINDS = ("secret", "email", "access_key", "ip", "date", "ssn", "phone", "card", "iban")
#: Days from 1900-01-01 that dates are permuted among: 252 x 290 of them, to 2100-02-01.
FIRST_DAY, DAY_HIGH, DAY_LOW = "1900-01-01", 252, 290
#: Days over the 12th among them, 12 a month less: 204 x 217.
LATE_HIGH, LATE_LOW = 204, 217
#: Areas of social security numbers: 001 to 665 and 667 to 899.
AREAS = 898


def is_full(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second from the right doubled."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d - F.when(d > 9, 9).otherwise(0))


def iban_rest(s: Column) -> Column:
    """The remainder mod 97 of an IBAN's number; 1 if it is valid."""
    s = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda r, c: (F.when(c.rlike("[0-9]"), r * 10).otherwise(r * 100) + value(c)) % 97)


def feistel(high: Column, low: Column, n_high: Column, n_low: Column, key: str, kind: Column, restore: bool = False) -> Column:
    """struct<high, low> permuted among n_high x n_low pairs: each round adds a keyed digest of one part to the other, modulo its size."""

    def noise(x: Column, i: Column, n: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long") % n

    def step(acc: Column, i: Column) -> Column:
        sign = -1 if restore else 1
        new_high = F.when(i % 2 == 0, F.pmod(acc["high"] + sign * noise(acc["low"], i, n_high), n_high)).otherwise(acc["high"])
        new_low = F.when(i % 2 == 1, F.pmod(acc["low"] + sign * noise(acc["high"], i, n_low), n_low)).otherwise(acc["low"])
        return F.struct(new_high.alias("high"), new_low.alias("low"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if restore else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(high.cast("long").alias("high"), low.cast("long").alias("low")), step)


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, key: str, kind: Column, restore: bool) -> Column:
    """A string of 2 to 34 digits permuted among those of its length."""
    half = (F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    out = feistel(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1), power_of_ten(half), power_of_ten(rest), key, kind, restore)
    return let(out, lambda o: F.concat(F.lpad(o["high"].cast("string"), half, "0"), F.lpad(o["low"].cast("string"), rest, "0")))


def in_shape(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in turn."""
    put = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
    )
    return put["out"]


def card(s: Column, key: str, restore: bool) -> Column:
    """The leading digit stays, the check digit follows the rest."""

    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    digits = digits_of(s)
    inner = permuted_digits(F.substr(digits, F.lit(2), F.length(digits) - 2), key, F.lit("card"), restore)
    return in_shape(s, let(F.concat(F.substr(digits, F.lit(1), F.lit(1)), inner), checked))


def ip(s: Column, key: str, restore: bool) -> Column:
    octets = F.split(s, r"\.")
    part = lambda i: F.element_at(octets, i).cast("long")
    out = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, F.lit("ip"), restore)
    return let(out, lambda o: F.concat_ws(".", *[x.cast("string") for h in ("high", "low") for x in (F.floor(o[h] / 256), o[h] % 256)]))


def phone(s: Column, key: str, restore: bool) -> Column:
    """The country code stays. In North America the area and the exchange keep a first digit of 2 to 9."""
    digits = digits_of(s)
    local = F.substr(digits, F.greatest(F.length(digits) - 9, F.lit(1)))
    american = (s.rlike(r"^\+1\D") | ~s.startswith("+")) & local.rlike("^[2-9]..[2-9]......$") & (F.length(digits) - F.when(s.startswith("+"), 1).otherwise(0) == 10)
    line = F.substr(local, F.lit(4)).cast("long") - 2_000_000
    us = feistel(F.substr(local, F.lit(1), F.lit(3)).cast("long") - 200, line, F.lit(800), F.lit(8_000_000), key, F.lit("phone"), restore)
    us = let(us, lambda o: F.concat((o["high"] + 200).cast("string"), (o["low"] + 2_000_000).cast("string")))
    code = F.regexp_extract(s, r"^\+(\d{1,3}?)(?:[ .(-]|\d{6})", 1)
    code = F.when(code == "", F.substr(digits, F.lit(1), F.lit(1))).otherwise(code)
    abroad = F.concat(code, permuted_digits(F.substr(digits, F.length(code) + 1), key, F.lit("phone"), restore))
    return in_shape(s, F.when(american, F.concat(F.when(s.startswith("+"), "1").otherwise(""), us)).otherwise(abroad))


def as_day(s: Column) -> Column:
    """The day of a date in any of the formats; null if there is none."""
    part = lambda i, n: F.substr(s, F.lit(i), F.lit(n))
    month, day = (F.when(month_first(s), part(i, 2)).otherwise(part(j, 2)) for i, j in ((1, 4), (4, 1)))
    iso = F.when(s.rlike(r"^\d{4}-"), s).otherwise(F.concat_ws("-", part(7, 4), month, day))
    return F.try_to_date(iso, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))


def month_first(s: Column) -> Column:
    """Whether a date's second number is over 12, so that it can only be a day."""
    return s.rlike(r"^\d\d[./](?:1[3-9]|[23]\d)")


def late_day(s: Column, key: str, restore: bool) -> Column:
    """A month-first date permuted among the days over the 12th, so that it stays one that can only be read month-first."""
    first = lambda months: F.add_months(F.lit(FIRST_DAY).cast("date"), months.cast("int"))
    months = (F.substr(s, F.lit(7), F.lit(4)).cast("long") - int(FIRST_DAY[:4])) * 12 + F.substr(s, F.lit(1), F.lit(2)).cast("long") - 1
    days_before = lambda m: F.datediff(first(m), F.lit(FIRST_DAY).cast("date")).cast("long") - 12 * m
    rank = days_before(months) + F.substr(s, F.lit(4), F.lit(2)).cast("long") - 13
    out = feistel(F.floor(rank / LATE_LOW), rank % LATE_LOW, F.lit(LATE_HIGH), F.lit(LATE_LOW), key, F.lit("late"), restore)

    def at(new: Column) -> Column:
        # A month has 18.44 such days on average, and no month begins two or more away from that.
        guess = F.floor(new * 2401 / (LATE_HIGH * LATE_LOW))
        month = F.array_max(F.filter(F.sequence(F.greatest(guess - 2, F.lit(0)), guess + 2), lambda m: days_before(m) <= new))
        return let(month, lambda m: F.date_add(first(m), (new - days_before(m) + 12).cast("int")))

    new = let(let(out, lambda o: o["high"] * LATE_LOW + o["low"]), at)
    sep = F.substr(s, F.lit(3), F.lit(1))
    return let(new, lambda d: F.concat_ws("", F.date_format(d, "MM"), sep, F.date_format(d, "dd"), sep, F.date_format(d, "yyyy")))


def date(s: Column, key: str, restore: bool) -> Column:
    day = F.datediff(as_day(s), F.lit(FIRST_DAY).cast("date"))
    out = feistel(F.floor(day / DAY_LOW), day % DAY_LOW, F.lit(DAY_HIGH), F.lit(DAY_LOW), key, F.lit("date"), restore)
    new = let(out, lambda o: F.date_add(F.lit(FIRST_DAY).cast("date"), (o["high"] * DAY_LOW + o["low"]).cast("int")))
    sep = F.substr(s, F.lit(3), F.lit(1))
    early = F.when(s.rlike(r"^\d{4}-"), F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat_ws("", F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy")))
    return F.when(month_first(s), late_day(s, key, restore)).otherwise(early)


def ssn(s: Column, key: str, restore: bool) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    serial = (F.substr(s, F.lit(5), F.lit(2)).cast("long") - 1) * 9999 + F.substr(s, F.lit(8), F.lit(4)).cast("long") - 1
    area = F.substr(s, F.lit(1), F.lit(3)).cast("long") - 1
    out = feistel(area - F.when(area >= 665, 1).otherwise(0), serial, F.lit(AREAS), F.lit(99 * 9999), key, F.lit("ssn"), restore)
    new_area = lambda a: a + 1 + F.when(a >= 665, 1).otherwise(0)
    return let(out, lambda o: F.format_string("%03d-%02d-%04d", new_area(o["high"]), F.floor(o["low"] / 9999) + 1, o["low"] % 9999 + 1))


def iban(s: Column, key: str, restore: bool) -> Column:
    """The country and the letters stay; the digits of the account are permuted and the check digits follow."""
    body = F.substr(s, F.lit(5))
    moved = in_shape(body, permuted_digits(digits_of(body), key, F.lit("iban"), restore))
    country = F.substr(s, F.lit(1), F.lit(2))
    return let(moved, lambda b: F.concat(country, F.lpad((F.lit(98) - iban_rest(F.concat(country, F.lit("00"), b))).cast("string"), F.lit(2), "0"), b))


def digest(s: Column, key: str, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), s), 256)


def secret(s: Column, key: str) -> Column:
    """The name stays; the value becomes as many characters of its keyed digest."""
    value = F.regexp_extract(s, r"([A-Za-z0-9_+/.~-]+)$", 1)
    return F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(value)), F.rpad(digest(value, key, "secret"), F.length(value), "0"))


def email(s: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substr(digest(F.lower(s), key, "email"), F.lit(1), F.lit(16)), F.lit("@example.invalid"))


def access_key(s: Column, key: str) -> Column:
    return F.concat(F.substr(s, F.lit(1), F.lit(4)), F.upper(F.substr(digest(s, key, "access_key"), F.lit(1), F.lit(16))))


def kind_of(s: Column) -> Column:
    """The kind of a match of PATTERN, null if it fails validation."""
    digits = digits_of(s)
    octets_fit = F.forall(F.split(s, r"\."), lambda x: x.cast("int") <= 255)
    day = as_day(s)
    real_day = day.isNotNull() & (F.datediff(day, F.lit(FIRST_DAY).cast("date")) >= 0) & (F.datediff(day, F.lit(FIRST_DAY).cast("date")) < DAY_HIGH * DAY_LOW)
    return (
        F.when(is_full(s, SECRET), "secret")
        .when(s.contains("@"), "email")
        .when(is_full(s, "(?:AKIA|ASIA)[A-Z0-9]{16}"), "access_key")
        .when(is_full(s, r"\d{1,3}(?:\.\d{1,3}){3}"), F.when(octets_fit, "ip"))
        .when(is_full(s, r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}"), F.when(real_day, "date"))
        .when(is_full(s, r"\d{3}-\d\d-\d{4}"), F.when(~s.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(s.startswith("+") & F.length(digits).between(8, 15), "phone")
        .when(is_full(s, PHONE_US), "phone")
        .when(is_full(s, r"[A-Z]{2}\d\d[A-Z0-9 ]+") & (iban_rest(s) == 1) & F.length(digits_of(F.substr(s, F.lit(5)))).between(2, 34), "iban")
    )


def pseudonym(kind: Column, s: Column, key: str, restore: bool) -> Column:
    new = F.when(kind == "ip", ip(s, key, restore)).when(kind == "phone", phone(s, key, restore))
    new = new.when(kind == "date", date(s, key, restore)).when(kind == "ssn", ssn(s, key, restore)).when(kind == "iban", iban(s, key, restore))
    if not restore:
        new = new.when(kind == "secret", secret(s, key)).when(kind == "email", email(s, key)).when(kind == "access_key", access_key(s, key))
    return new.otherwise(s)


def run_cards(run: Column) -> Column:
    """Distinct cards of a run of digit groups: windows of groups, 13 to 19 digits, with a valid check digit. Of two that overlap the more usual one stays."""
    windows = F.concat(*[F.regexp_extract_all(run, F.lit(rf"(?<![0-9A-Za-z])(?=({p}(?!\d)))"), F.lit(1)) for p in CARD_GROUPS])
    fit = lambda w: F.length(digits_of(w)).between(13, 19) & (luhn_sum(digits_of(w)) % 10 == 0)
    # Cards begin with 3 to 6, some with 22 to 27, and a permutation keeps the first digit.
    rank = lambda w: F.when(w.rlike("^[3-6]"), 0).otherwise(2) + F.when(is_full(w, rf"\d+|{CARD_USUAL}"), 0).otherwise(1)
    place = lambda w: F.struct(rank(w).alias("rank"), (-F.length(w)).alias("size"), F.instr(run, w).alias("at"), w.alias("w"))
    ordered = F.array_sort(F.transform(F.filter(F.array_distinct(windows), fit), place))
    meets = lambda a, b: (a["at"] < b["at"] - b["size"]) & (b["at"] < a["at"] - a["size"])
    none = F.array().cast("array<struct<rank:int,size:int,at:int,w:string>>")
    chosen = F.aggregate(ordered, none, lambda acc, w: F.when(F.exists(acc, lambda a: meets(a, w)), acc).otherwise(F.concat(acc, F.array(w))))
    return F.transform(chosen, lambda x: x["w"])


def cards_of(text: Column) -> Column:
    """Distinct cards of a text, longest first, outside of other values; what only looks like an IBAN is no such value."""
    outside = lambda s: is_full(s, GROUPS) | (is_full(s, IBAN) & (iban_rest(s) != 1))
    found = F.flatten(F.transform(F.filter(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), outside), run_cards))
    ordered = F.array_sort(F.transform(F.array_distinct(found), lambda w: F.struct((-F.length(w)).alias("size"), w.alias("w"))))
    return F.when(text.rlike(r"\d(?:[ -]?\d){12}"), F.transform(ordered, lambda x: x["w"]))


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting. Without one, a local master gets the public demonstration key and a warning, any other an error."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY_SETTING}: pseudonyms under the public demonstration key can be undone by anyone")
    if not found:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the public demonstration key", stacklevel=2)
    return found or DEMO_KEY


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting. Off a local master, where the public one is refused, a session without a key gets a random one.

    It stays in the setting, so all of the session's pseudonyms are linked and can be undone with what the setting holds; once
    the session is over without anybody having kept it, they can't.
    """
    if not spark.conf.get(KEY_SETTING, None) and not spark.sparkContext.master.startswith("local"):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
        warnings.warn(f"{KEY_SETTING} was not set: pseudonyms are made with a random key of this session, which the setting holds now; other sessions' pseudonyms differ", stacklevel=2)
    return key_of(spark)


def pseudonymise(docs: DataFrame, key: str, restore: bool = False) -> DataFrame:
    """docs with its text pseudonymised under the key, plus pii_kinds (in place of a column of that name): the kinds replaced, one for each occurrence.

    The text is cut at the cards, and what is between them at the other matches; gaps and new values are joined again, so nothing
    else in it changes. Where groups beside a card happen to make a second valid card with it, restoring may choose the other one.
    """
    pii = free_names(docs, "pii_matches")[0]
    gate = F.coalesce(F.col("text").rlike(GATE), F.lit(False))
    found = docs.withColumn(pii, F.when(gate, cards_of(F.col("text"))))
    either = F.concat(F.lit(r"(?<!\d)(?:"), F.array_join(pii, "|"), F.lit(r")(?!\d)"))
    some = F.size(pii) > 0
    cut = F.struct(F.when(some, F.split("text", either)).otherwise(F.array("text")).alias("parts"), F.when(some, F.regexp_extract_all("text", either, F.lit(0))).otherwise(F.array().cast("array<string>")).alias("cards"))
    found = found.withColumn(pii, F.when(gate, cut))

    def replaced(part: Column) -> Column:
        def joined(matches: Column) -> Column:
            def put(kinds: Column) -> Column:
                pairs = F.zip_with(kinds, matches, lambda k, s: pseudonym(k, s, key, restore))
                text = F.array_join(F.zip_with(F.split(part, PATTERN), F.concat(pairs, F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
                return F.struct(F.when(F.size(matches) > 0, text).otherwise(part).alias("text"), F.filter(kinds, lambda k: k.isNotNull()).alias("kinds"))

            return let(F.transform(matches, kind_of), put)

        return let(F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0)), joined)

    found = found.withColumn(pii, F.zip_with(F.transform(f"{pii}.parts", replaced), f"{pii}.cards", lambda p, c: F.struct(F.concat(p["text"], F.coalesce(card(c, key, restore), F.lit(""))).alias("text"), F.when(c.isNull(), p["kinds"]).otherwise(F.concat(p["kinds"], F.array(F.lit("card")))).alias("kinds"))))
    text = F.when(gate, F.array_join(f"{pii}.text", "")).otherwise(F.col("text"))
    out = found.withColumns({"text": text, "pii_kinds": F.coalesce(F.flatten(f"{pii}.kinds"), F.array().cast("array<string>"))}).drop(pii)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    counts = [(F.size("pii_kinds") - F.size(F.array_remove(F.col("pii_kinds"), kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return done.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_pii"), *counts)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its columns, its text pseudonymised and n_chars to match."""
    return pseudonymise(docs, session_key(spark)).select(*docs.columns)
