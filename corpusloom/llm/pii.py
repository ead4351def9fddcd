"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Every value found and validated is permuted inside its own format by a keyed Feistel
network, so equal values have equal pseudonyms in all documents and different values
never collide.  A value is cut into two halves, numbers modulo a and b; in turn one
half has a keyed hash (SHA-256 of key, kind, round and the other half) added to it.

Kinds: cards (Luhn; the check digit is made anew), IBANs (mod 97; check digits made
anew), phone numbers, social security numbers, dates in 1800-2199 (as day numbers),
IPv4 addresses (as 32-bit numbers), e-mail local parts (letters and digits apart) and
secrets (access keys, prefixed tokens, password= and token = values).  What fails its validation stays.
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The session's setting that holds the key, and the key of tests.
KEY_SETTING, TEST_KEY = "spark.corpusloom.pseudonym.key", "corpusloom"
ROUNDS = 8
CHUNK = 16
SECRET_WORD = r"(?i:password|passwd|token|secret|api_key)\s?[=:]"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IBAN_LENGTHS = dict(zip(
    "NO BE DK FI FO GL NL MK SI AT BA EE KZ LT LU XK CH HR LI LV BG BH CR DE GB GE IE ME RS VA AE GI IL AD CZ ES MD PK RO SA SE SK TN VG PT IS TR"
    " FR GR IT MC MR SM AL AZ BY CY DO GT HU LB PL BR PS QA UA JO KW MU MT".split(),
    [15, 16, *[18] * 5, *[19] * 2, *[20] * 7, *[21] * 4, *[22] * 10, *[23] * 3, *[24] * 11, 25, *[26] * 2, *[27] * 6, *[28] * 9, *[29] * 4, *[30] * 3, 31],
))


def _printed_ibans() -> str:
    """IBANs in groups of four; only whole ones, so that no other value beside them is taken in."""
    forms = []
    for n in sorted(set(IBAN_LENGTHS.values())):
        rest = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
        forms.append(f"(?:{'|'.join(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n)})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}")
    return "|".join(forms)


#: Kinds in the order in which they are tried at each place of a text.
PATTERNS = {
    # One try for each run of letters, of the 64 characters and 10 labels that an address has at most: linear in any text.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,63}",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|(?=[A-Z]{{2}}[0-9]{{2}} )(?:{_printed_ibans()}))(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}"
            r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?:(?<![0-9A-Za-z.,:/+-])[2-9][0-9]{2}(?: [2-9][0-9]{2} |[2-9][0-9]{2})[0-9]{4}(?![0-9A-Za-z/-]|[.,:][0-9])|\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"
             r"|(?<![0-9A-Za-z.,:/-])(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,3}[ /])[0-9]{3,4} ?[0-9]{3,4}|(?<![0-9A-Za-z.,:/-])0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4})"
             r"|\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4})(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])[spr]k_(?:live|test)_[A-Za-z0-9]{16,}+(?![A-Za-z0-9_])",
    "secret": SECRET_WORD + r"""\s?["']?[0-9a-f]{16,}+(?![0-9A-Za-z])""",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 26: "abcdefghijklmnopqrstuvwxyz", 36: "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BASE_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
DAY_RANGE = (189, 773)  # 146,097 days, the 400 years from 1800 on


def _hash(key: str, tweak: Column, i: Column, half: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """Struct (l, r) in Z_a x Z_b, permuted."""
    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["l"] + _hash(key, tweak, i, acc["r"])) % a).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise((acc["r"] + _hash(key, tweak, i, acc["l"])) % b).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _with(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def permute(s: Column, radix: int, key: str, tweak: Column) -> Column:
    """A string over the radix's alphabet, permuted among those of its length, CHUNK characters at a time."""
    alphabet, digits = ALPHABETS[radix], BASE_DIGITS[:radix]

    def number(part: Column) -> Column:
        plain = part if radix != 26 else F.translate(part, alphabet, digits)
        return F.coalesce(F.conv(plain, radix, 10).cast("long"), F.lit(0).cast("long"))

    def text(n: Column, size: Column) -> Column:
        out = F.lower(F.conv(n.cast("string"), 10, radix))
        out = F.when(size > 0, F.lpad(out, size, "0")).otherwise(F.lit(""))
        return out if radix in (10, 16) else F.translate(out, digits, alphabet)

    def chunk(part: Column, j: Column) -> Column:
        k = F.floor(F.length(part) / 2).cast("int")
        rest = F.length(part) - k
        size = lambda n: F.round(F.pow(F.lit(float(radix)), n)).cast("long")
        done = feistel(number(F.substr(part, F.lit(1), k)), number(F.substr(part, k + 1, rest)), size(k), size(rest), key, F.concat_ws("|", tweak, j.cast("string"), F.length(part).cast("string")))
        return _with(done, lambda d: F.concat(text(d["l"], k), text(d["r"], rest)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / CHUNK).cast("int")), lambda j: chunk(F.substr(s, j * CHUNK + 1, F.lit(CHUNK)), j))
    return F.when(F.length(s) > 0, F.array_join(chunks, "")).otherwise(s)


def _refill(value: Column, kind: str, fresh: Column) -> Column:
    """``value`` with the characters of the class ``kind`` taken in order from ``fresh``, upper case kept."""
    def put(acc: Column, c: Column) -> Column:
        hit = c.rlike(kind)
        new = F.substr(fresh, acc["n"] + 1, F.lit(1))
        return F.struct(
            (acc["n"] + hit.cast("int")).alias("n"),
            F.concat(acc["s"], F.when(~hit, c).when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).alias("s"),
        )

    return F.aggregate(F.split(value, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), put, lambda acc: acc["s"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum; the last digit counts once."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0)))),
        F.lit(0), lambda acc, x: acc + x,
    )


def _mod97(text: Column) -> Column:
    """The number that letters (A = 10) and digits spell, modulo 97."""
    codes = F.transform(F.split(text, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(codes, F.lit(0), lambda acc, x: (acc * F.when(x > 9, F.lit(100)).otherwise(F.lit(10)) + x) % 97)


def _card(value: Column, key: str) -> Column:
    def renew(d: Column) -> Column:
        body = permute(F.substr(d, F.lit(1), F.length(d) - 1), 10, key, F.lit("card"))
        return _with(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return F.when(_luhn_sum(_digits(value)) % 10 == 0, _refill(value, "[0-9]", _with(_digits(value), renew))).otherwise(value)


def _iban(value: Column, key: str) -> Column:
    """Blanks between groups are left where they are and change nothing else."""
    def compact(v: Column) -> Column:
        bban, country = F.substr(v, F.lit(5), F.lit(40)), F.substr(v, F.lit(1), F.lit(2))
        valid = _mod97(F.concat(bban, F.substr(v, F.lit(1), F.lit(4)))) == 1
        fresh = _refill(bban, "[0-9]", permute(_digits(bban), 10, key, F.concat(F.lit("iban|"), F.regexp_replace(bban, "[0-9]", "#"))))
        check = lambda account: 98 - _mod97(F.concat(account, country, F.lit("00")))
        return F.when(valid, _with(fresh, lambda a: F.concat(country, F.lpad(check(a).cast("string"), 2, "0"), a))).otherwise(v)

    return _with(_with(F.regexp_replace(value, " ", ""), compact), lambda new: F.when(value.contains(" "), _refill(value, "[A-Z0-9]", new)).otherwise(new))


def _date(value: Column, key: str) -> Column:
    """Days and months of one digit may become two, as the form has no fixed length."""
    full = value.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$")

    def form_of(full_form: str) -> Column:
        return F.when(full, F.lit(full_form)).otherwise(F.lit(full_form.replace("MM", "M").replace("dd", "d")))

    form = F.when(value.rlike("-"), form_of("yyyy-MM-dd")).when(value.rlike("/"), form_of("dd/MM/yyyy")).otherwise(form_of("dd.MM.yyyy"))
    us = form_of("MM/dd/yyyy")
    day = F.coalesce(F.try_to_timestamp(value, form), F.when(value.rlike("/"), F.try_to_timestamp(value, us))).cast("date")
    form = F.when(F.try_to_timestamp(value, form).isNull(), us).otherwise(form)
    zero = F.lit("1800-01-01").cast("date")
    n = F.datediff(day, zero)
    a, b = DAY_RANGE
    out = _with(feistel(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, F.lit("date")), lambda d: F.date_add(zero, (d["l"] * b + d["r"]).cast("int")))
    forms = [g for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy") for g in (f, f.replace("MM", "M").replace("dd", "d"))] + ["d.M.yyyy"]
    written = F.when(F.lit(False), F.lit(""))
    for f in forms:
        written = written.when(form == f, F.date_format(out, f))
    return F.when((n >= 0) & (n < a * b), written.otherwise(F.date_format(out, "dd.MM.yyyy"))).otherwise(value)


def _ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
    half = F.lit(65536).cast("long")

    def write(d: Column) -> Column:
        octets = [F.floor(d["l"] / 256), d["l"] % 256, F.floor(d["r"] / 256), d["r"] % 256]
        return F.concat_ws(".", *[x.cast("long").cast("string") for x in octets])

    return _with(part, lambda p: _with(feistel(F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)), half, half, key, F.lit("ip")), write))


def _email(value: Column, key: str) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.lower(F.substring_index(value, "@", -1))
    letters = permute(F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), 26, key, F.concat(F.lit("email|"), domain))
    numbers = permute(_digits(local), 10, key, F.concat(F.lit("email|"), domain))
    return F.concat(_refill(_refill(local, "[A-Za-z]", letters), "[0-9]", numbers), F.lit("@"), F.substring_index(value, "@", -1))


def _plain(kind: str):
    return lambda value, key: _refill(value, "[0-9]", permute(_digits(value), 10, key, F.lit(kind)))


def _phone(value: Column, key: str) -> Column:
    """The country code stays."""
    head = F.regexp_extract(value, r"^\+(?:1|[0-9]{1,3}(?=[ .(-])|)", 0)
    rest = F.substr(value, F.length(head) + 1, F.length(value))
    return F.concat(head, _refill(rest, "[0-9]", permute(_digits(rest), 10, key, F.lit("phone"))))


def _key(value: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), permute(F.substr(value, F.lit(5), F.lit(16)), 36, key, F.lit("key")))


def _secret(value: Column, key: str) -> Column:
    tail = F.regexp_extract(value, "[0-9a-f]+$", 0)
    return F.concat(F.substr(value, F.lit(1), F.length(value) - F.length(tail)), permute(tail, 16, key, F.lit("secret")))


def _token(value: Column, key: str) -> Column:
    """Letters are permuted among letters and digits among digits; the prefix stays."""
    head = F.regexp_extract(value, "^[spr]k_(?:live|test)_", 0)
    rest = F.substr(value, F.length(head) + 1, F.length(value))
    letters = permute(F.lower(F.regexp_replace(rest, "[0-9]", "")), 26, key, F.concat(F.lit("token|"), head))
    numbers = permute(_digits(rest), 10, key, F.concat(F.lit("token|"), head))
    return F.concat(head, _refill(_refill(rest, "[A-Za-z]", letters), "[0-9]", numbers))


RULES = {"email": _email, "ip": _ip, "date": _date, "iban": _iban, "card": _card, "phone": _phone, "ssn": _plain("ssn"), "key": _key, "token": _token, "secret": _secret}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value that matches a pattern."""
    out = F.when(value.rlike("^(?:" + PATTERNS["email"] + ")$"), _email(value, key))
    for kind, rule in RULES.items():
        if kind != "email":
            out = out.when(value.rlike("^(?:" + PATTERNS[kind] + ")$"), rule(value, key))
    return out.otherwise(value)


def key_of(spark: SparkSession) -> str:
    """The secret of the pseudonyms: ``spark.corpusloom.pseudonym.key`` of the session.

    Only a local master (tests, a laptop) may leave it unset and gets TEST_KEY, which
    everybody knows; on a cluster pseudonyms that anyone can invert are an error.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{KEY_SETTING} must name the secret of the pseudonyms")
    return key or TEST_KEY


#: Secrets drawn for applications that name none, by application; only the driver's process keeps them.
_DRAWN: dict[str, str] = {}


def key_or_drawn(spark: SparkSession) -> str:
    """key_of(), or on a cluster whose session names no key a random secret, one for each application.

    With a drawn secret equal values have equal pseudonyms in all jobs of the application,
    another application gives others, and nobody can invert them once it has ended.
    """
    try:
        return key_of(spark)
    except ValueError:
        warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms by a secret drawn for this application", stacklevel=2)
        return _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_values") -> DataFrame:
    """``docs`` with the values in ``text`` replaced, and ``count`` (long), how many changed.

    NULL stays NULL (0 values); a text without values stays as it is; every other
    column, repeated rows and the order of the columns stay; a column ``count`` of
    ``docs`` is replaced.  Each row is done by itself, in time linear in its length.
    """
    t = F.col(text)
    worth = t.rlike("[0-9@]") | t.contains("AKIA") | t.rlike(SECRET_WORD) | t.rlike("[spr]k_(?:live|test)_")
    own = [c for c in docs.columns if c != count]
    old, new = fresh(docs, "_found"), fresh(docs, "_new")
    found = docs.select(*own, F.when(worth, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).alias(old))
    renewed = found.select(*own, old, F.when(F.size(old) > 0, F.transform(old, lambda v: pseudonym(v, key))).alias(new))
    pieces = F.zip_with(F.split(t, ANY, -1), F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
    return renewed.select(
        *[c if c != text else F.when(F.col(new).isNotNull(), F.array_join(pieces, "")).otherwise(t).alias(text) for c in own],
        F.when(F.col(new).isNotNull(), changed).otherwise(F.lit(0)).cast("long").alias(count),
    )
