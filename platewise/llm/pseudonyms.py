"""Format-preserving pseudonyms by a keyed Feistel network, in built-in functions only.

Personal numbers, dates and addresses are found by pattern and validated (check digits, octets, calendar). Each value's own characters, without
separators, are halved; eight rounds add keyed digests of one half to the other, digit by digit within the digits and letter by letter within the
letters. The result has the same format and length, equal values have equal pseudonyms in every document, and the key undoes the step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import col, fresh

ROUNDS = 8
#: A cycle of the Gregorian calendar, 400 years of 146,097 days, as the product of two near factors.
CYCLE, WEEKS, DAYS = 146097, 189, 773

#: Letters and digits that are permuted, each within its own row: first code point and number of characters.
ALPHABETS = [(0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8), (0x3B1, 25), (0x410, 32), (0x430, 32), (0x4E00, 20902)]
LETTERS = "0-9A-Za-z\u00C0-\u00D6\u00D8-\u00DE\u00E0-\u00F6\u00F8-\u00FF\u03B1-\u03C9\u0410-\u044F\u4E00-\u9FA5"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}][\p{L}\p{N}.-]{0,250}\.\p{L}{2,24}"
SECRET = r"(?i:(?:token|key|secret|password)\s?[=:]\s?[\"']?)[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
DATE_YMD = r"(?<![\d./-])\d{4}-\d{2}-\d{2}(?![\d/-]|\.\d)"
DATE_DMY = r"(?<![\d./-])\d{1,2}([/.])\d{1,2}\1\d{4}(?![\d/-]|\.\d)"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
PHONE = r"(?<![\d+])\+(?:\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}|[ .-]\d){3,6})(?!\d)"
#: Country codes of telephone numbers.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: A run of digit groups, in which the cards are looked for; it ends before dates, national numbers and what goes on after a point or stroke.
CARD = r"(?<!\d)(?<!\d\.)\d(?:(?:[ -](?!\d+[./]\d|\d{4}-\d{2}-\d{2}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d)))?\d){12,}+(?!\.\d)"
#: Characters of an account number by country.
LANDS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
         24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
         31: "MT SC", 32: "LC", 33: "RU"}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(v.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, v in LANDS.items()) \
    + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
NATIONAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Tried in this order where several start at the same place.
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, DATE_YMD, DATE_DMY.replace("\\1", "[/.]").replace("([/.])", "[/.]"), ADDRESS, PHONE, IBAN, NATIONAL, CARD))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def add_digest(text: Column, digest: Column, hexadecimal: bool) -> Column:
    """Each digit moved by a byte of the hex `digest` within 0-9, each letter within its alphabet (a-f in hexadecimal values)."""
    def moved(i: Column) -> Column:
        c = F.ascii(F.substring(text, i, F.lit(1)))
        by = F.conv(F.substring(digest, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
        if hexadecimal:
            base = F.when(c < 58, 48).when(c < 91, 65).otherwise(97)
            return F.char(base + (c - base + by) % F.when(c < 58, 10).otherwise(6))
        base, size = c, F.lit(1)
        for first, many in ALPHABETS:
            here = c.between(first, first + many - 1)
            base, size = F.when(here, first).otherwise(base), F.when(here, many).otherwise(size)
        return let(base + (c - base + by) % size, lambda n: F.when(n < 128, F.char(n)).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")))

    n = F.length(text)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), moved), "")).otherwise("")


def long_digest(base: Column, size: Column) -> Column:
    """Hex digits for `size` characters, two each: a digest for every 64."""
    more = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((size - 1) / 64).cast("int"))), lambda j: F.sha2(F.concat_ws("|", base, j.cast("string")), 512))
    return F.concat(F.sha2(base, 512), F.when(size > 64, F.array_join(more, "")).otherwise(""))


def feistel(core: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Permutation of letter-and-digit strings of one length and character pattern."""
    half = F.floor(F.length(core) / 2).cast("int")
    start = F.struct(F.substring(core, F.lit(1), half).alias("l"), F.substring(core, half + 1, F.length(core)).alias("r"))

    def step(s: Column, turn: Column) -> Column:
        digest = long_digest(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), s["r"]), F.length(s["l"]))
        return F.struct(s["r"].alias("l"), let(digest, lambda d: add_digest(s["l"], d, hexadecimal)).alias("r"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return let(end, lambda s: F.concat(s["l"], s["r"]))


def put_back(form: Column, core: Column, letters: str = "0-9A-Za-z") -> Column:
    """`core` written over the letters and digits of `form`, separators left in place."""
    def at(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), f"[^{letters}]", ""))
        return F.when(c.rlike(f"[{letters}]"), F.substring(core, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), at), "")


def integer_rounds(left: Column, right: Column, key: str, kind: str, sizes: tuple[int, int], use: Callable[[Column, Column], Column]) -> Column:
    """`use(a, b)` of the pair permuted over 0..sizes[0]-1 x 0..sizes[1]-1: keyed digests of one part added to the other, in turn."""
    def digest(turn: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("bigint")

    def step(s: Column, turn: Column) -> Column:
        return let((s["a"] + digest(turn, s["b"])) % sizes[0], lambda a: F.struct(a.alias("a"), ((s["b"] + digest(-turn, a)) % sizes[1]).alias("b")))

    start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step), lambda s: use(s["a"], s["b"]))


def card(m: Column, key: str) -> Column:
    """All digits but the check digit permuted, then the digit that makes the number valid."""
    def number(d: Column) -> Column:
        payload = feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return let(payload, lambda p: F.concat(p, F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: F.call_function("luhn_check", F.concat(p, x)))[0]))

    return put_back(m, number(digits(m)))


def cards(m: Column, key: str) -> Column:
    """struct(now, n): a run of digit groups with its cards replaced, and their number. The whole run is tried first, then from left to right four groups of four digits,
    groups of 4, 6 and 5, and single groups of 13 to 19."""
    groups, marks = F.regexp_extract_all(m, F.lit("[0-9]+"), 0), F.split(m, "[0-9]+")
    valid = lambda p: F.call_function("luhn_check", digits(p))

    def split_up(g: Column, mark: Column) -> Column:
        def piece(i: Column, k: int) -> Column:
            return F.array_join(F.zip_with(F.slice(g, i + 1, k), F.concat(F.slice(mark, i + 2, k - 1), F.array(F.lit(""))), lambda d, b: F.concat(d, b)), "")

        def step(s: Column, i: Column) -> Column:
            size = lambda k: F.length(F.get(g, i + k))
            fits = lambda *n: F.coalesce(F.forall(F.array(*[size(k) == v for k, v in enumerate(n)]), lambda x: x), F.lit(False))
            k = F.when(fits(4, 4, 4, 4) & valid(piece(i, 4)), 4).when(fits(4, 6, 5) & valid(piece(i, 3)), 3).when(size(0).between(13, 19) & valid(piece(i, 1)), 1).otherwise(0)
            part = lambda k: F.when(k == 4, piece(i, 4)).when(k == 3, piece(i, 3)).otherwise(F.get(g, i))
            taken = lambda k: F.struct(F.concat(s["out"], F.array(F.struct(F.get(mark, i).alias("mark"), part(k).alias("part"), (k > 0).alias("card")))).alias("out"), F.greatest(k - 1, F.lit(0)).alias("skip"))
            return F.when(s["skip"] > 0, F.struct(s["out"].alias("out"), (s["skip"] - 1).alias("skip"))).otherwise(let(k, taken))

        start = F.struct(F.array().cast("array<struct<mark:string,part:string,card:boolean>>").alias("out"), F.lit(0).alias("skip"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step)["out"]

    def written(parts: Column) -> Column:
        text = F.array_join(F.transform(parts, lambda p: F.concat(p["mark"], F.when(p["card"], card(p["part"], key)).otherwise(p["part"]))), "")
        return F.struct(text.alias("now"), F.size(F.filter(parts, lambda p: p["card"])).alias("n"))

    whole = (F.length(digits(m)) <= 19) & valid(m)
    parts = let(groups, lambda g: let(marks, lambda mark: split_up(g, mark)))
    return F.when(whole, F.struct(card(m, key).alias("now"), F.lit(1).alias("n"))).otherwise(let(parts, written))


def mod97(text: Column) -> Column:
    """Remainder by 97 of a number with letters as 10 to 35."""
    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban_valid(m: Column) -> Column:
    core = F.regexp_replace(m, " ", "")
    return F.length(core).between(15, 34) & (mod97(F.concat(F.substring(core, F.lit(5), F.length(core)), F.substring(core, 1, 4))) == 1)


def iban(m: Column, key: str) -> Column:
    """The account part permuted, then the check digits that make it valid."""
    core = F.regexp_replace(m, " ", "")
    land = F.substring(m, 1, 2)
    account = feistel(F.substring(core, F.lit(5), F.length(core)), key, "iban")
    return let(account, lambda a: put_back(m, F.concat(land, F.lpad((98 - mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0"), a)))


def octets_valid(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)


def address(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    return let(o, lambda o: integer_rounds(o[0] * 256 + o[1], o[2] * 256 + o[3], key, "address", (65536, 65536), lambda a, b: F.concat_ws(
        ".", *[x.cast("string") for x in (F.floor(a / 256), a % 256, F.floor(b / 256), b % 256)])))


def day_parts(m: Column) -> Column:
    """struct(y, mo, d, month_first) of a matched date; day first unless only month first is a date."""
    def parts(p: Column) -> Column:
        swap = (p[0] <= 12) & (p[1] > 12)
        year_first = F.length(F.regexp_extract(m, r"^\d+", 0)) == 4
        return F.when(year_first, F.struct(p[0].alias("y"), p[1].alias("mo"), p[2].alias("d"), F.lit(False).alias("us"))).otherwise(
            F.struct(p[2].alias("y"), F.when(swap, p[0]).otherwise(p[1]).alias("mo"), F.when(swap, p[1]).otherwise(p[0]).alias("d"), swap.alias("us")))

    return let(F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int")), parts)


def date_valid(m: Column) -> Column:
    def ok(p: Column) -> Column:
        leap = (p["y"] % 4 == 0) & ((p["y"] % 100 != 0) | (p["y"] % 400 == 0))
        last = F.when(p["mo"] == 2, F.when(leap, 29).otherwise(28)).when(p["mo"].isin(4, 6, 9, 11), 30).otherwise(31)
        return (p["y"] >= 1) & p["mo"].between(1, 12) & (p["d"] >= 1) & (p["d"] <= last)

    return let(day_parts(m), ok)


def date(m: Column, key: str) -> Column:
    """The day's number permuted within its 400-year cycle (the last one is cut short, so years past 9600 keep to 9201 to 9600) and written in the same form."""
    origin = F.lit("0001-01-01").cast("date")

    def written(p: Column) -> Column:
        number = F.datediff(F.make_date(p["y"], p["mo"], p["d"]), origin).cast("bigint")

        def day(n: Column) -> Column:
            base = F.least(F.floor(n / CYCLE), F.lit(23)) * CYCLE
            return let(base, lambda b: integer_rounds(F.floor((n - b) % CYCLE / DAYS), (n - b) % CYCLE % DAYS, key, "date", (WEEKS, DAYS),
                                                      lambda x, y: F.date_add(origin, (b + x * DAYS + y).cast("int"))))

        def form(d: Column) -> Column:
            year, month, dom = F.lpad(F.year(d).cast("string"), 4, "0"), F.month(d).cast("string"), F.day(d).cast("string")
            two = lambda x: F.when(F.length(m) == 10, F.lpad(x, 2, "0")).otherwise(x)
            mark = F.regexp_extract(m, r"\D", 0)
            return F.when(mark == "-", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(dom, 2, "0"))).otherwise(
                F.concat(F.when(p["us"], two(month)).otherwise(two(dom)), mark, F.when(p["us"], two(dom)).otherwise(two(month)), mark, year))

        return let(let(number, day), form)

    return let(day_parts(m), written)


def pseudonym(m: Column, key: str) -> Column:
    """struct(now, n): the pseudonym of a match and how many values it holds; `now` is null where it isn't valid."""
    whole = lambda p: F.lit(f"^(?:{p})$")
    is_a = lambda p: F.regexp_like(m, whole(p))
    local, rest = F.regexp_extract(m, "^[^@]+", 0), F.regexp_extract(m, "@.*$", 0)
    name = F.regexp_extract(m, "^.*?[=:]\\s?[\"']?", 0)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    prefix = F.regexp_extract(m, COUNTRY, 0)
    number = F.substring(m, F.length(prefix) + 1, F.length(m))
    mixed = lambda x: F.regexp_replace(x, f"[^{LETTERS}]", "")
    single = (
        F.when(F.contains(m, F.lit("@")), F.concat(put_back(local, feistel(mixed(local), key, "email"), LETTERS), rest))
        .when(F.regexp_like(m, F.lit("[=:]")), F.concat(name, feistel(value, key, "secret", True)))
        .when(is_a(DATE_YMD) | is_a(DATE_DMY), F.when(date_valid(m), date(m, key)))
        .when(is_a(ADDRESS), F.when(octets_valid(m), address(m, key)))
        .when(is_a(PHONE), F.concat(prefix, put_back(number, feistel(digits(number), key, "phone"))))
        .when(is_a(IBAN), F.when(iban_valid(m), iban(m, key)))
        .when(is_a(NATIONAL), put_back(m, feistel(digits(m), key, "national"))))
    run = is_a(CARD) & ~(is_a(DATE_YMD) | is_a(NATIONAL))
    return F.when(run, cards(m, key)).otherwise(let(single, lambda x: F.struct(x.alias("now"), F.when(x.isNull(), 0).otherwise(1).alias("n"))))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """`docs` with the personal values in `text` replaced and their number added as `count` (numbered if the frame has such a column).

    Values: e-mail addresses (the local part; Latin, Greek, Cyrillic and Han letters), telephone numbers after the country code, valid IPv4 addresses, payment cards and account numbers
    (check digits renewed), calendar dates, national numbers of the form 3-2-4, and hexadecimal secrets of 32 digits and more named as such. What fails its validation is left as it is, as
    is all other text. Null stays null with count 0; repeated rows get the same result; all other columns are kept."""
    source = col(text).cast("string")
    marks = F.transform(F.regexp_extract_all(source, F.lit(PATTERN), 0), lambda m: let(pseudonym(m, key), lambda p: F.struct(m.alias("was"), p["now"].alias("now"), p["n"].alias("n"))))

    def replaced(found: Column) -> Column:
        pieces = F.zip_with(F.split(source, PATTERN, -1), found, lambda gap, f: F.concat(gap, F.coalesce(f["now"], f["was"], F.lit(""))))
        return F.struct(F.array_join(pieces, "").alias("text"), F.aggregate(found, F.lit(0), lambda n, f: n + f["n"]).cast("bigint").alias("n"))

    done = fresh(docs, "_done")
    out = docs.withColumn(done, F.when(source.rlike("[0-9@=:]"), let(marks, replaced)).otherwise(F.struct(source.alias("text"), F.lit(0).cast("bigint").alias("n"))))
    return out.select(*[col(f"{done}").getField("text").alias(text) if c == text else col(c) for c in docs.columns],
                      F.coalesce(col(done).getField("n"), F.lit(0).cast("bigint")).alias(fresh(docs, count)))
