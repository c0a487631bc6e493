import datetime
import hashlib
import re

import pytest

from platewise.llm import pseudonyms
from tests.llm.helpers import frame
from tests.llm.test_text import brute_feistel, digest_add, iban_ok, luhn

C, A, M, I, S = "4111 1111 1111 1111", "3782 822463 10005", "5555555555554444", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332"
#: Text, its values, and what else of the text must stay.
CASES = [(f"{C} 12/27", [C]), (f"{C} 123", [C]), (f"pay 5 {C}", [C]), (f"2024 {C} 2025", [C]), (f"card-{C}.", [C]), (f"no.{M}", [M]), (f"{C} {M} {A} 7", [C, M, A]), (f"x {A} 12.50", [A]),
         (f"{I} BIC", [I]), (f"{S} EUR", [S]), (f"{I} {C}", [I, C]), ("call +33 1 23 45 67 89 now", ["+33 1 23 45 67 89"])]
UNTOUCHED = ["1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17", "4111 1111 1111 1112 4111", f"1.{M}", f"{M}.5", "AT61 1904 3002 3457 3202 BIC"]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(100 + i, t) for i, t in enumerate(UNTOUCHED)]
    return {r["doc_id"]: r for r in pseudonyms.pseudonymise(frame(spark, rows, extra=False), "k").collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_values_beside_other_digits_and_capitals(got, number):
    text, values = CASES[number]
    r = got[number]
    pattern = re.escape(text)
    for v in values:
        pattern = pattern.replace(re.escape(v), "(" + re.sub(r"[0-9A-Z]", "[0-9A-Z]", v.replace("+", r"\+")) + ")", 1)
    now = re.fullmatch(pattern, r["text"]).groups()
    assert r["n_pseudonyms"] == len(values)
    for v, n in zip(values, now):
        assert n != v and (iban_ok(n) if v[0].isalpha() else v[0] == "+" or luhn(n))


def long_feistel(core, key, kind):
    """Hexadecimal digits by the rounds of the module, with a digest for every 64 characters of a half."""
    left, right = core[:len(core) // 2], core[len(core) // 2:]
    for turn in range(1, 9):
        base = f"{key}|{kind}|{turn}|{right}"
        digest = "".join(hashlib.sha512((base + (f"|{j}" if j else "")).encode()).hexdigest() for j in range(-(-len(left) // 64) or 1))
        left, right = right, digest_add(left, digest, True)
    return left + right


@pytest.mark.parametrize("size, quote", [(32, ""), (128, ""), (129, "'"), (200, '"'), (1000, ""), (20001, "'")])
def test_secrets_of_any_length_and_quote(spark, size, quote):
    value = "".join("0123456789abcdefABCDEF"[i * 7919 % 22] for i in range(size))
    text = f"secret={quote}{value}{quote} end"
    row = pseudonyms.pseudonymise(frame(spark, [(1, text)], extra=False), "k").first()
    assert row["text"] == f"secret={quote}{long_feistel(value, 'k', 'secret')}{quote} end" and row["n_pseudonyms"] == 1


@pytest.mark.parametrize("name", ["josé", "müller.öz", "иван.петров", "ΑΒγδ", "李雷", "x_é9"])
def test_mail_names_beyond_ascii(spark, name):
    row = pseudonyms.pseudonymise(frame(spark, [(1, f"to {name}@x.com now")], extra=False), "k").first()
    now = re.fullmatch(r"to (\S+)@x\.com now", row["text"])[1]
    assert row["n_pseudonyms"] == 1 and len(now) == len(name) and now != name
    # Upper-case Greek is not in the alphabets and stays; all else moves within its own.
    assert [c.isalnum() for c in now] == [c.isalnum() for c in name] and all(a == b for a, b in zip(now, name) if not a.isalnum())


@pytest.mark.parametrize("text, kept", [("+14155551234", "+1"), ("+442071838750", "+44"), ("+35312345678", "+353"), ("+7 495 123 45 67", "+7")])
def test_country_codes_are_kept_and_no_more(spark, text, kept):
    now = pseudonyms.pseudonymise(frame(spark, [(1, f"call {text}")], extra=False), "k").first()["text"][5:]
    assert now.startswith(kept) and re.sub(r"\D", "", now[len(kept):]) == brute_feistel(re.sub(r"\D", "", text[len(kept):]), "k", "phone")


def number(key, kind, turn, x):
    return int(hashlib.sha256(f"{key}|{kind}|{turn}|{x}".encode()).hexdigest()[:12], 16)


def pair(a, b, kind, sizes):
    for turn in range(1, pseudonyms.ROUNDS // 2 + 1):
        a = (a + number("k", kind, turn, b)) % sizes[0]
        b = (b + number("k", kind, -turn, a)) % sizes[1]
    return a, b


def test_dates_addresses_and_accounts_equal_brute_force(spark):
    day = datetime.date(1984, 2, 29)
    n = (day - datetime.date(1, 1, 1)).days
    low = n // 146097 * 146097
    a, b = pair((n - low) // 773, (n - low) % 773, "date", (189, 773))
    moved = datetime.date(1, 1, 1) + datetime.timedelta(low + a * 773 + b)
    x, y = pair(193 * 256 + 195, 198 * 256 + 107, "address", (65536, 65536))
    account = brute_feistel("370400440532013000", "k", "iban")
    check = 98 - int("".join(str(int(c, 36)) for c in account + "DE00")) % 97
    rows = [(1, "1984-02-29"), (2, "29.02.1984"), (3, "193.195.198.107"), (4, "DE89370400440532013000"), (5, "123-45-6789")]
    got = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(frame(spark, rows, extra=False), "k").collect()}
    national = brute_feistel("123456789", "k", "national")
    assert got == {1: moved.isoformat(), 2: moved.strftime("%d.%m.%Y"), 3: f"{x // 256}.{x % 256}.{y // 256}.{y % 256}", 4: f"DE{check:02d}{account}",
                   5: f"{national[:3]}-{national[3:5]}-{national[5:]}"}


def test_values_that_fail_stay(got):
    assert [got[100 + i]["text"] for i in range(len(UNTOUCHED))] == UNTOUCHED
