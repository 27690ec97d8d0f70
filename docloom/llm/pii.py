"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame expressions only.

Values that validate (card numbers by prefix, length and check digit, phone numbers, dotted
addresses, calendar dates, social security numbers) are permuted by a keyed Feistel network
inside their own format: a card number becomes another valid card number with its first
digit kept, a social security number another valid one, a date another date of the same 400
years, separators stay where they are. Being a permutation, it keeps equal values equal and
different ones different, across all documents; inverting it needs only the key. Phone
numbers are linked by country code and digits, however they are written; a number of ten
digits without a code counts as one of +1. Mail addresses and secrets (long hexadecimal
strings and access keys by their prefix), which have no such domain, get keyed digests of
the same shape, of 128 bits where the shape has room.

A text is split at its matches and joined again around their pseudonyms, so no value is
ever looked up in a table, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Where the queries and the pipeline find the key, which a run must set for itself.
KEY_SETTING = "spark.docloom.pseudonym.key"

_MAIL = r"[\p{L}\p{N}_][\p{L}\p{N}._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_ADDRESS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4}"
_SOCIAL = r"\d{3}-\d{2}-\d{4}"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}"
#: Each issuer's first digits with its lengths, the longest first: digits that follow a card may be taken in, and _card_part leaves them outside again.
_CARD = "|".join(
    rf"(?={prefix}){prefix[0]}(?:[ -]?\d){{{n - 1}}}" for prefix, lengths in (("4", (19, 16)), ("5[ -]?[1-5]", (16,)), ("2[ -]?[2-7]", (16,)), ("3[ -]?5", (19, 18, 17, 16)), ("3[ -]?[47]", (15,)), ("3[ -]?[068]", (14,)), ("6[ -]?[045]", (19, 18, 17, 16))) for n in lengths
)
_TOKEN = r"AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36,}"
_SECRET = rf"[0-9a-f]{{32,}}|[0-9A-F]{{32,}}|{_TOKEN}"
#: A value stands alone: no letter, digit or joining mark beside it.
PATTERN = (
    rf"(?<![\p{{L}}\p{{N}}_%+-])(?:{_MAIL})"
    rf"|(?<![\p{{L}}\p{{N}}_+-])(?<!\d\.)(?:(?:{_SECRET})|(?:{_DATE})|(?:{_ADDRESS})|(?:{_SOCIAL})|(?:{_PHONE})|(?:{_CARD})(?![/@]))(?![\p{{L}}\p{{N}}_]|[.-]\d)"
    # A card may also have an expiry or security code joined to it. Cards of 13 digits come last, as longer ones can begin like them.
    rf"|(?<![\p{{L}}\p{{N}}_+-])(?<!\d\.)(?:{_CARD}|4(?:[ -]?\d){{12}})(?![\p{{L}}\p{{N}}_]|\.\d)"
)
#: What any match holds; texts without it are passed through unsearched.
_HINT = r"@|\d[ .-]?\d|[0-9a-fA-F]{32}|AKIA|sk-|gh[pousr]_"


def _draw(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """48 pseudo-random bits for one round."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def permute(value: Column, left: Column, right: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 <= value < left * right (bigints): an unbalanced Feistel network.

    Rounds add to one half, modulo its size, a draw from the other; halves need no common size.
    """
    start = F.struct(((value - F.pmod(value, right)) / right).cast("bigint").alias("l"), F.pmod(value, right).cast("bigint").alias("r"))

    def turn(at: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, at["r"]).otherwise(at["l"])
        drawn = _draw(key, tweak, i, other)
        return F.struct(
            F.when(i % 2 == 0, F.pmod(at["l"] + F.pmod(drawn, left), left)).otherwise(at["l"]).alias("l"),
            F.when(i % 2 == 0, at["r"]).otherwise(F.pmod(at["r"] + F.pmod(drawn, right), right)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda at: at["l"] * right + at["r"])


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("bigint") for i in range(10)]), (n + 1).cast("int"))


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Another string of as many digits, up to 18."""
    n = F.length(digits)
    left, right = _power(F.floor(n / 2)), _power(n - F.floor(n / 2))
    return F.lpad(permute(digits.cast("bigint"), left, right, key, tweak).cast("string"), n, "0")


def _luhn(digits: Column) -> Column:
    """The sum of the check, the last digit counting once."""
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, i: s + _let(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)
        ),
    )


def _is_card(d: Column) -> Column:
    """Prefix and length of the known issuers, then the check digit."""
    n = F.length(d)
    known = (
        (d.rlike("^4") & n.isin(13, 16, 19))
        | (d.rlike("^(5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)") & (n == 16))
        | (d.rlike("^3[47]") & (n == 15))
        | (d.rlike("^(6011|65|64[4-9]|35)") & n.between(16, 19))
        | (d.rlike("^3(0[0-5]|[68])") & (n == 14))
    )
    return known & F.when(known, _luhn(d) % 10 == 0).otherwise(False)


def _card_part(m: Column) -> Column:
    """The card that m begins with, up to the end of a group of digits: of 16 digits if that is valid, then shorter, then longer ones. Null without any."""
    parts = F.array(*[F.regexp_extract(m, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0) for n in (16, 15, 14, 13, 17, 18, 19)])
    return F.get(F.filter(parts, lambda part: _is_card(F.regexp_replace(part, r"\D", ""))), F.lit(0))


def _card(d: Column, key: str) -> Column:
    """The issuer's first digits stay; the others are permuted and the check digit follows."""
    keep = F.when(d.startswith("4"), 1).when(d.startswith("2") | d.startswith("60") | d.startswith("64"), 4).when(d.startswith("30"), 3).otherwise(2)
    inner = F.substring(d, keep + 1, F.length(d) - keep - 1)
    body = F.concat(F.substring(d, F.lit(1), keep), permute_digits(inner, key, F.concat(F.lit("card"), F.substring(d, F.lit(1), keep), F.length(d).cast("string"))))
    return _let(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by digits."""
    chars = F.split(shape, "")
    before = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), r"\D", ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, before(i) + 1, F.lit(1))).otherwise(c)), "")


#: Days of 400 Gregorian years, 27 x 5411, from 1800-01-01 to 2199-12-31.
_FIRST_DAY, _DAYS_LEFT, _DAYS_RIGHT = -62091, 27, 5411


def _date_of(m: Column) -> Column:
    parts = F.split(m, "[/.]")
    dmy = F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    mdy = F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"))
    read = lambda s: F.try_to_date(s, "yyyy-MM-dd")
    return F.when(m.rlike(r"^\d{4}-"), read(m)).when(m.contains("/"), F.coalesce(read(mdy), read(dmy))).otherwise(read(dmy))


def _date(m: Column, key: str) -> Column:
    """A date of the same 400 years in the same format; others are no dates here. Two formats of one day stay linked."""

    def moved(day: Column) -> Column:
        n = (F.unix_date(day) - F.lit(_FIRST_DAY)).cast("bigint")
        to = F.date_from_unix_date((permute(n, F.lit(_DAYS_LEFT).cast("bigint"), F.lit(_DAYS_RIGHT).cast("bigint"), key, F.lit("date")) + _FIRST_DAY).cast("int"))
        as_mdy = m.contains("/") & F.try_to_date(F.concat_ws("-", F.get(F.split(m, "/"), F.lit(2)), F.lpad(F.get(F.split(m, "/"), F.lit(0)), 2, "0"), F.lpad(F.get(F.split(m, "/"), F.lit(1)), 2, "0")), "yyyy-MM-dd").isNotNull()
        return F.when(m.rlike(r"^\d{4}-"), F.date_format(to, "yyyy-MM-dd")).when(as_mdy, F.date_format(to, "MM/dd/yyyy")).when(m.contains("/"), F.date_format(to, "dd/MM/yyyy")).otherwise(F.date_format(to, "dd.MM.yyyy"))

    inside = lambda day: F.year(day).between(1800, 2199)
    return _let(_date_of(m), lambda day: F.when(inside(day), moved(day)).otherwise(m))


def _address(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))

    def moved(o: Column) -> Column:
        value = ((F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1))) * 256 + F.get(o, F.lit(2))) * 256 + F.get(o, F.lit(3))
        half = F.lit(65536).cast("bigint")
        to = permute(value, half, half, key, F.lit("address"))
        return F.when(F.array_max(o) > 255, m).otherwise(
            _let(to, lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
        )

    return _let(octets, moved)


def _mail(m: Column, key: str) -> Column:
    """A name of 32 letters from a keyed digest, 128 bits, under a domain that cannot exist."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)), 256)
    return F.concat(F.translate(F.substring(digest, 1, 32), "0123456789", "ghijklmnop"), F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    digest = lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(m), i.cast("string")), 256)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(m) / 64).cast("int")), digest), "")
    text = F.substring(text, F.lit(1), F.length(m))
    prefix = F.regexp_extract(m, r"^(AKIA|sk-|gh[pousr]_)", 1)
    rest = F.when(m.rlike("[A-F]") & ~m.rlike("[a-z]"), F.upper(text)).otherwise(text)
    return F.concat(prefix, F.substring(rest, F.length(prefix) + 1, F.length(m)))


#: Valid social security numbers: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def _social(d: Column, key: str) -> Column:
    """Nine digits of another valid number."""
    part = lambda a, n: F.substring(d, a, n).cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    value = (area * _GROUPS + part(4, 2) - 1) * _SERIALS + part(6, 4) - 1
    moved = permute(value, F.lit(_AREAS).cast("bigint"), F.lit(_GROUPS * _SERIALS).cast("bigint"), key, F.lit("social"))

    def written(v: Column) -> Column:
        serial, rest = F.pmod(v, F.lit(_SERIALS)), F.floor(v / _SERIALS).cast("bigint")
        group, place = F.pmod(rest, F.lit(_GROUPS)), F.floor(rest / _GROUPS).cast("bigint")
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat(pad(place + F.when(place >= 665, 2).otherwise(1), 3), pad(group + 1, 2), pad(serial + 1, 4))

    return _let(moved, written)


def kind_of(m: Column) -> Column:
    """card, phone, address, date, social, mail or secret; null for what doesn't validate."""
    digits = F.regexp_replace(m, r"\D", "")
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    return (
        F.when(m.contains("@"), F.lit("mail"))
        .when(whole(_TOKEN) | whole(_SECRET) & m.rlike("[A-Fa-f]"), F.lit("secret"))
        .when(whole(_DATE), F.when(F.year(_date_of(m)).between(1800, 2199), F.lit("date")))
        .when(whole(_ADDRESS), F.when(F.array_max(F.transform(F.split(m, r"\."), lambda x: x.cast("int"))) <= 255, F.lit("address")))
        .when(whole(_SOCIAL), F.when(~m.rlike(r"^(000|666|9..)|-00-|-0000$"), F.lit("social")))
        .when(whole(_PHONE) & F.length(digits).between(9, 15), F.lit("phone"))
        .when(_card_part(m).isNotNull(), F.lit("card"))
    )


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one matched value; what doesn't validate is returned as it is."""
    digits = F.regexp_replace(m, r"\D", "")

    def phone(d: Column) -> Column:
        # The country code stays: up to the first separator, or the 1 before ten digits.
        told = F.when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1))).otherwise(0)
        code = F.when((told == 0) & m.startswith("+") & d.rlike(r"^1\d{10}$"), 1).otherwise(told)
        rest = F.substring(d, code + 1, F.length(d))
        country = F.when((code == 0) & (F.length(d) == 10), F.lit("1")).otherwise(F.substring(d, F.lit(1), code))
        return _refill(m, F.concat(F.substring(d, F.lit(1), code), permute_digits(rest, key, F.concat(F.lit("phone"), country))))

    return _let(
        kind_of(m),
        lambda kind: F.when(kind == "mail", _mail(m, key))
        .when(kind == "secret", _secret(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "address", _address(m, key))
        .when(kind == "social", _refill(m, _let(digits, lambda d: _social(d, key))))
        .when(kind == "phone", _let(digits, phone))
        .when(kind == "card", _let(_card_part(m), lambda c: F.concat(_refill(c, _let(F.regexp_replace(c, r"\D", ""), lambda d: _card(d, key))), F.substring(m, F.length(c) + 1, F.length(m)))))
        .otherwise(m),
    )


def configured_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING; a local session without one gets a key that protects nothing, for tests."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key
    if not spark.conf.get("spark.docloom.pseudonym.required", "false") == "true":
        return "for tests only"
    raise ValueError(f"set {KEY_SETTING}")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with `text` rewritten and n_values, how many values were replaced; a column n_values is replaced.

    A null text stays null with 0 values; texts without personal values stay as they are.
    Texts of any length are searched whole, and rows that repeat change alike.
    """
    hit = F.col(text).rlike(_HINT) & F.col(text).rlike(PATTERN)
    found = F.when(hit, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    rest = [c for c in docs.columns if c not in (text, "n_values")]
    parts = docs.select(*rest, text, found.alias("_found"))
    pieces = F.split(F.col(text), PATTERN, -1)
    replaced = F.transform("_found", lambda m: F.struct(m.alias("from"), pseudonym(m, key).alias("to")))
    parts = parts.withColumn("_pairs", replaced)
    joined = F.array_join(F.zip_with(pieces, F.col("_pairs"), lambda piece, p: F.concat(piece, F.coalesce(p["to"], F.lit("")))), "")
    changed = F.size(F.filter("_pairs", lambda p: p["from"] != p["to"]))
    return parts.select(
        *rest, F.when(F.col("_found").isNull(), F.col(text)).otherwise(joined).alias(text), F.when(F.col("_found").isNull(), 0).otherwise(changed).cast("int").alias("n_values")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal values."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, configured_key(spark)).select("doc_id", "text", "n_values")
