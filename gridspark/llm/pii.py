"""Format-preserving Feistel pseudonyms for personal data, in DataFrame expressions alone.

One pattern finds candidates; those that validate (Luhn, calendar, octet range, mod 97, issued areas) are replaced by
a keyed permutation within their own format: separators, lengths and check digits stay right, so a card number stays a
valid card number. The permutation doesn't depend on the document, so that equal values stay linked everywhere.

A number of a domain of A * B values is a pair (a, b); each round adds a keyed hash of one part to the other, modulo
its size, which is a bijection for any A and B. Strings (mail addresses, secrets) use the same network over halves,
letter by letter within the letter's class. Account parts of IBANs that hold letters do so too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Permutations that a cycle walk takes at most.
WALKS = 160
#: The default key is for tests and examples; set your own in the Spark setting KEY_SETTING and keep it secret.
KEY, KEY_SETTING = "change-me", "spark.gridspark.pii.key"
#: What a candidate looks like, in the order in which they are tried.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|api_key|apikey|token)\s?[=:]\s?[\"']?[A-Za-z0-9_\-]{8,}|(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
#: Length of the account part of each country's IBAN: figures and letters after the check digits.
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV", 18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL",
    20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST", 22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
#: By country; figures in groups of four for any other one.
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ -]?[0-9A-Z]){{{n}}}" for n, c in IBAN_LENGTHS.items()) + "|[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,6}(?: ?[0-9]{1,3})?)(?![A-Za-z0-9])"
#: Numbers after a word for a version are no addresses.
IPV4 = r"(?<![0-9A-Za-z.])(?<!(?i:version|release|ver\.|build) )(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = "(?<![0-9./-])(?:" + "|".join(f"[0-9]{{4}}{c}[0-9]{{1,2}}{c}[0-9]{{1,2}}|[0-9]{{1,2}}{c}[0-9]{{1,2}}{c}[0-9]{{4}}" for c in ("-", "/", "[.]")) + ")(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: International and North American numbers; national ones of Germany (0 and an area), France (five pairs), Spain.
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])"
    r"|(?<![0-9A-Za-z.,/-])(?:0[1-9](?:[ .-][0-9]{2}){4}|\(?0[1-9][0-9]{1,3}\)?[ /-]{1,3}[0-9]{3,8}(?:[ -][0-9]{1,5})?|[6-9][0-9]{2}(?:[ -][0-9]{3}){2}|[6-9][0-9]{2}(?:[ -][0-9]{2}){3})(?![0-9]|[.,/-][0-9])"
)
#: Groups as cards have them; four figures before or up to three after 16 may be another number (a year, a code).
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){4}(?![ -]?[0-9])|[0-9]{4}(?:[ -]?[0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{3}){3}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{5}|[0-9]{6}[ -][0-9]{13}|[0-9]{8}[ -][0-9]{8})(?![0-9])"
PATTERN = "|".join([EMAIL, SECRET, IBAN, IPV4, DATE, SSN, CARD, PHONE])


def _prf(key: str, *parts: Column) -> Column:
    """52 bits of SHA-256 of the key and the parts, as a long."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("long")


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_number(n: Column, a: int, b: int, tag: str, key: str) -> Column:
    """Keyed bijection on 0 <= n < a * b."""
    y = F.pmod(n, F.lit(b).cast("long"))
    start = F.struct(F.call_function("div", n - y, F.lit(b).cast("long")).alias("x"), y.alias("y"))

    def step(s: Column, r: Column) -> Column:
        size = F.when(r % 2 == 0, F.lit(a)).otherwise(F.lit(b))
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + _prf(key, F.lit(tag), r, s["y"]), size).alias("y"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _long_pair(start), lambda s, r: _long_pair(step(s, r)))
    return _bind(end, lambda s: s["x"] * F.lit(b).cast("long") + s["y"])


def _long_pair(s: Column) -> Column:
    return F.struct(s["x"].cast("long").alias("x"), s["y"].cast("long").alias("y"))


def permute_digits(d: Column, tag: str, key: str) -> Column:
    """Keyed bijection on the digit strings of each length from 2 to 18; a single digit is shifted."""
    out = F.when(F.length(d) == 1, F.pmod(d.cast("long") + _prf(key, F.lit(tag + "1")), F.lit(10)).cast("string"))
    for n in range(2, 19):
        number = permute_number(d.cast("long"), 10 ** (n // 2), 10 ** (n - n // 2), f"{tag}{n}", key)
        out = out.when(F.length(d) == n, F.lpad(number.cast("string"), n, "0"))
    return out


def walked(value: Column, permute: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """Cycle walking: value permuted until the result is valid, as value itself is; so valid values map one to one onto
    each other. Of the domains used here a share of 0.2 at least is valid, so that WALKS permutations always meet one."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))
    tried = lambda v: _bind(permute(v), lambda w: F.struct(w.alias("v"), valid(w).alias("done")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda s, _: F.when(s["done"], s).otherwise(tried(s["v"])), lambda s: s["v"])


def letters_class(s: Column) -> Column:
    """0 for strings of hexadecimal digits in lower case that hold a letter, 1 for long ones in upper case, 2 for others."""
    return F.when(s.rlike("^[0-9a-f]+$") & s.rlike("[a-f]"), 0).when(s.rlike("^[0-9A-F]{32,}$") & s.rlike("[A-F]"), 1).otherwise(2)


def permute_letters(s: Column, tag: str, key: str) -> Column:
    """Keyed bijection on strings that keeps length and letters_class(), and of other strings each character's class: 0-9,
    a-z, A-Z; others stay."""
    return _bind(F.struct(s.alias("s"), letters_class(s).alias("k")), lambda p: walked(p["s"], lambda v: _permuted(v, p["k"], tag, key), lambda v: letters_class(v) == p["k"]))


def _permuted(s: Column, kind: Column, tag: str, key: str) -> Column:
    def shift(c: Column, k: Column) -> Column:
        figure = F.conv(F.pmod(F.conv(c, 16, 10).cast("int") + k, F.lit(16)).cast("string"), 10, 16)
        return F.when(kind == 0, F.lower(figure)).when(kind == 1, figure).otherwise(by_class(c, k))

    def by_class(c: Column, k: Column) -> Column:
        code = F.ascii(c)
        moved = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + k, F.lit(size)))
        return F.when(c.rlike("^[0-9]$"), moved(48, 10)).when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).otherwise(c)

    def step(p: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), F.length(p["x"]).cast("string"), p["y"]).cast("binary"), 256)
        letters = F.filter(F.split(p["x"], ""), lambda c: c != "")

        def new(hashed: Column) -> Column:
            return F.array_join(F.transform(letters, lambda c, i: shift(c, F.conv(F.substring(hashed, (i % 31) * 2 + 1, 4), 16, 10).cast("int") + i)), "")

        return F.struct(p["y"].alias("x"), _bind(stream, new).alias("y"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("x"), F.substring(s, half + 1, F.length(s)).alias("y"))
    return _bind(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda p: F.concat(p["x"], p["y"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _laid(m: Column, digits: Column, kind: str = "^[0-9]$") -> Column:
    """m with its digits (characters of a kind) replaced by the given ones, in order."""
    step = lambda s, c: F.when(c.rlike(kind), F.struct(F.concat(s["o"], F.substring(s["d"], 1, 1)).alias("o"), F.substring(s["d"], 2, 64).alias("d"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["d"].alias("d")))
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("o"), digits.alias("d")), step, lambda s: s["o"])


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string, from its right end."""

    def worth(c: Column, i: Column) -> Column:
        v = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return v - F.when(v > 9, 9).otherwise(0)

    figures = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    return F.aggregate(F.transform(figures, worth), F.lit(0), lambda s, v: s + v)


def card(m: Column, key: str) -> Column:
    """A card number that passes Luhn: first digit, length and grouping stay, the check digit is made right. Of
    groups that don't pass as a whole, those without a short last one, then the last four, are tried."""
    valid = lambda part: F.length(_digits(part)).between(13, 19) & (luhn_sum(_digits(part)) % 10 == 0)
    front, back = F.regexp_extract(m, "^(.{16,19})[ -][0-9]{1,4}$", 1), F.regexp_extract(m, "^[0-9]{4}[ -](.{19})$", 1)
    part = F.coalesce(F.when(valid(m), m), F.when((F.length(_digits(front)) == 16) & valid(front), front), F.when(valid(back), back))

    def new(part: Column) -> Column:
        at = F.call_function("instr", m, part)
        return F.concat(F.substring(m, F.lit(1), at - 1), _card(part, key), F.substring(m, at + F.length(part), F.length(m)))

    return _bind(part, lambda p: F.when(p.isNotNull(), new(p)))


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), "card", key))
        check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        return _laid(m, F.concat(body, check))

    return _bind(_digits(m), new)


def ipv4(m: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        n = sum((p[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), p[0].cast("long") * 256**3)
        out = permute_number(n, 65536, 65536, "ip", key)
        return _bind(out, lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]))

    parts = F.split(m, r"\.")
    valid = F.forall(parts, lambda x: x.cast("int") < 256)
    return F.when(valid, _bind(parts, new))


def date(m: Column, key: str) -> Column:
    """A calendar date from 1900 to 2099 becomes another one of its century in the same notation, figures of day and
    month included."""
    iso = m.rlike("^[0-9]{4}")
    parts = F.split(m, "[./-]")
    day_first = ~iso & (parts[1].cast("int") <= 12)
    year, month, day = (F.when(iso, parts[i]).otherwise(other) for i, other in ((0, parts[2]), (1, F.when(day_first, parts[1]).otherwise(parts[0])), (2, F.when(day_first, parts[0]).otherwise(parts[1]))))
    y, mo, d = year.cast("int"), month.cast("int"), day.cast("int")
    valid = F.when(mo.between(1, 12) & d.between(1, 31), F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd"))
    # a date that only reads with the month first stays one, so that no two dates share a pseudonym
    fits = lambda v: ((F.length(day) == 2) | (F.dayofmonth(v) < 10)) & ((F.length(month) == 2) | (F.month(v) < 10)) & (iso | day_first | (F.dayofmonth(v) > 12))

    def moved(first: str, a: int, b: int) -> Column:
        zero = F.lit(first).cast("date")
        permute = lambda v: F.date_add(zero, permute_number(F.datediff(v, zero).cast("long"), a, b, "date" + first[:2], key).cast("int"))
        return walked(valid, permute, fits)

    def shown(v: Column) -> Column:
        dd, mm, yy = F.lpad(F.dayofmonth(v).cast("string"), F.length(day), "0"), F.lpad(F.month(v).cast("string"), F.length(month), "0"), F.date_format(v, "yyyy")
        mark = F.regexp_extract(m, "[./-]", 0)
        return F.when(iso, F.concat(yy, mark, mm, mark, dd)).when(day_first, F.concat(dd, mark, mm, mark, yy)).otherwise(F.concat(mm, mark, dd, mark, yy))

    new = F.when(y.between(1900, 1999), moved("1900-01-01", 92, 397)).when(y.between(2000, 2099), moved("2000-01-01", 75, 487))
    return F.when(valid.isNotNull() & y.between(1900, 2099), _bind(new, shown))


def ssn(m: Column, key: str) -> Column:
    """Issued numbers only: areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999; the result is one too."""
    a, g, s = (x.cast("long") for x in (F.substring(m, 1, 3), F.substring(m, 5, 2), F.substring(m, 8, 4)))
    valid = a.between(1, 899) & (a != 666) & (g > 0) & (s > 0)
    area = a - 1 - F.when(a > 666, 1).otherwise(0)
    n = permute_number((area * 99 + (g - 1)) * 9999 + s - 1, 898, 99 * 9999, "ssn", key)

    def shown(v: Column) -> Column:
        area = F.floor(v / (99 * 9999)) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", area.cast("long"), (F.pmod(F.floor(v / 9999), F.lit(99)) + 1).cast("long"), (F.pmod(v, F.lit(9999)) + 1).cast("long"))

    return F.when(valid, _bind(n, shown))


def phone(m: Column, key: str) -> Column:
    """National digits are permuted; a country code after + and the notation stay, and so do leading digits of area
    and exchange from 2 to 9 in ten-digit numbers, 0 and the digit after it, and the first of other national numbers."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))

    def new(d: Column) -> Column:
        north = (F.length(d) == 10) & d.rlike("^[2-9][0-9]{2}[2-9]")
        area, exchange, line = F.substring(d, 1, 3).cast("long") - 200, F.substring(d, 4, 3).cast("long") - 200, F.substring(d, 7, 4).cast("long")
        n = (area * 800 + exchange) * 10_000 + line
        numbered = _bind(permute_number(n, 80_000, 80_000, "nanp", key), lambda v: F.format_string("%03d%03d%04d", (F.floor(v / 8_000_000) + 200).cast("long"), (F.pmod(F.floor(v / 10_000), F.lit(800)) + 200).cast("long"), F.pmod(v, F.lit(10_000)).cast("long")))
        stay = F.when(m.startswith("+"), 0).when(d.startswith("0"), 2).otherwise(1)
        other = F.concat(F.substring(d, F.lit(1), stay), permute_digits(F.substring(d, stay + 1, F.length(d)), "phone", key))
        return F.concat(code, _laid(rest, F.when(north, numbered).otherwise(other)))

    return _bind(_digits(rest), lambda d: F.when(F.length(d).between(6, 15), new(d)))


def iban(m: Column, key: str) -> Column:
    """Country, length and grouping stay, the check digits are made right. The last 16 of an account part of figures are
    permuted; one with letters is permuted as a whole, each character within its class."""
    plain = F.regexp_replace(m, "[ -]", "")
    country, rest = F.substring(plain, 1, 2), F.substring(plain, 5, 40)

    def mod(text: Column) -> Column:
        """The number modulo 97, letters as 10 to 35."""
        step = lambda n, c: F.pmod(n * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.conv(c, 36, 10).cast("int"), F.lit(97))
        return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)

    def new(rest: Column) -> Column:
        figures = F.concat(F.substring(rest, F.lit(1), F.length(rest) - 16), permute_digits(F.substring(rest, -16, 16), "iban", key))
        made = F.when(rest.rlike("[A-Z]"), permute_letters(rest, "iban", key)).otherwise(figures)
        return _bind(made, lambda b: F.concat(country, _laid(F.substring(m, 3, 80), F.concat(F.lpad((98 - mod(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b), "^[0-9A-Z]$")))

    return F.when(F.length(rest).between(11, 30), F.when(mod(F.concat(rest, F.substring(plain, 1, 4))) == 1, _bind(rest, new)))


def email(m: Column, key: str) -> Column:
    """Local part and domain name are permuted apart; the top-level domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    top = F.substring_index(domain, ".", -1)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    return F.concat(permute_letters(local, "local", key), F.lit("@"), permute_letters(name, "domain", key), top)


def secret(m: Column, key: str) -> Column:
    """Keys and passwords: the name in front and a known prefix stay, the value is permuted by class."""
    value = F.regexp_extract(m, r"[A-Za-z0-9_\-]+$", 0)
    known = F.regexp_extract(value, "^(?:AKIA|ASIA)(?=[0-9A-Z]{16}$)", 0)
    front = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(front, known, permute_letters(F.substring(value, F.length(known) + 1, F.length(value)), "secret", key))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate; the candidate itself where nothing validates."""
    full = lambda p: m.rlike(f"^(?:{p})$")
    return F.coalesce(
        F.when(full(EMAIL), email(m, key)),
        F.when(full(SECRET), secret(m, key)),
        F.when(full(IBAN), iban(m, key)),
        F.when(full(IPV4), ipv4(m, key)),
        F.when(full(DATE), date(m, key)),
        F.when(full(SSN), ssn(m, key)),
        F.when(full(CARD), card(m, key)),
        F.when(full(PHONE), phone(m, key)),
        m,
    )


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """Struct (text, n_found): the text with its personal data replaced, and how many values were. Null stays null."""

    def joined(found: Column) -> Column:
        new = F.transform(found, lambda m: pseudonym(m, key))
        gaps = F.split(text, PATTERN, -1)
        n = F.aggregate(F.zip_with(found, new, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
        laid = F.array_join(F.zip_with(gaps, new, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
        return F.struct(laid.alias("text"), n.alias("n_found"))

    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_found"))
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike("[0-9@]|(?i:password|passwd|secret|api_?key|token)"), _bind(found, lambda f: F.when(F.size(f) > 0, joined(f)).otherwise(none))).otherwise(none)


def pseudonymise(documents: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """All rows and columns of documents with the text replaced, and n_chars, where there is one, counted again:
    addresses can change their width. Null and empty texts stay as they are, repeated rows become equal ones, an empty
    table stays empty. key is that of KEY_SETTING unless given."""
    key = key or documents.sparkSession.conf.get(KEY_SETTING, KEY)
    out = documents.withColumn(text, pseudonymised(F.col(text), key)["text"])
    return out.withColumn("n_chars", F.length(text).cast(dict(documents.dtypes)["n_chars"])) if "n_chars" in documents.columns else out


def pseudonymise_documents(documents: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, and n_found of all documents. Null and empty texts stay; repeated rows are replaced
    alike; an empty table gives an empty one; other columns are ignored."""
    key = key or documents.sparkSession.conf.get(KEY_SETTING, KEY)
    made = documents.select("doc_id", pseudonymised(F.col("text"), key).alias("_new"))
    return made.select("doc_id", F.col("_new.text").alias("text"), F.col("_new.n_found").alias("n_found"))
