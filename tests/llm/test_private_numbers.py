import datetime
import re

import pytest

from tests.llm.conftest import rows
from tidegrid.llm.private_numbers import pseudonymise


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def by_97(iban):
    s = re.sub(r"\s", "", iban)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def replaced(spark, texts, key="secret", **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in sorted(pseudonymise(df, key, **options).collect())]


def test_values_stay_valid_linked_and_in_format(spark):
    texts = ["a 4111 1111 1111 1111 b", "4111-1111-1111-1111", "4111111111111111.", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
             "on 2024-02-29, 31.12.1999 or 31/12/1999", "+1 (017) 555-7713 x (212) 555-1234", "mail joe.Doe7@a.b.com", "ip 1.2.3.4!", "123-45-6789",
             "again joe.Doe7@a.b.com 1.2.3.4 +1 (017) 555-7713"]
    got = replaced(spark, texts)
    for text, (new, kinds) in zip(texts, got):
        assert new != text and kinds
        shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d+", "9", t)))
        assert shape(new) == shape(text)
    card = re.sub(r"\D", "", got[0][0])
    assert luhn(card) and card == re.sub(r"\D", "", got[1][0]) == re.sub(r"\D", "", got[2][0])
    assert by_97(got[3][0]) == 1 and by_97(got[4][0]) == 1
    a, b, c = re.findall(r"[\d./-]{10}", got[5][0])
    datetime.date.fromisoformat(a)
    assert datetime.datetime.strptime(b, "%d.%m.%Y") == datetime.datetime.strptime(c, "%d/%m/%Y")
    assert all(int(p) <= 255 for p in re.findall(r"\d+", got[8][0]))
    for n in (6, 7, 8):
        assert re.search(r"(\+1 \(\d+\) [\d-]+|\S+@a\.b\.com|[\d.]{7,}\d)", got[n][0])[0] in got[10][0]
    assert replaced(spark, texts[:1], key="other") != got[:1]


def test_distinct_values_stay_distinct(spark):
    days = [str(datetime.date(1999, 1, 1) + datetime.timedelta(n)) for n in range(400)]
    names = [f"{a}{b}@x.org" for a in "abcdefgh" for b in range(50)]
    addresses = [f"10.0.{a}.{b}" for a in range(20) for b in range(20)]
    for values in (days, names, addresses):
        assert len({t for t, _ in replaced(spark, values)}) == len(values)


def test_invalid_values_and_odd_rows(spark):
    left = ["4111111111111112", "2023-02-30", "1700-01-01", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "DE88370400440532013000", "x@y", "", None,
            "no numbers", "1234", "a" * 20000 + "9" * 30]
    assert replaced(spark, left) == [(t, []) for t in left]
    df = spark.createDataFrame([(1, "1.2.3.4", "k")] * 2, "doc_id long, text string, kinds string")
    out = pseudonymise(df, "secret")
    assert out.columns == ["doc_id", "text", "kinds", "_kinds"] and len(set(rows(out.drop("_kinds")))) == 1
    assert rows(pseudonymise(df.limit(0), "secret")) == []


def test_values_beside_other_numbers_and_words(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    texts = {
        f"{card} 12/27": ["card"], "4111111111111111 100 EUR": ["card"], f"order 12 {card}": ["card"], f"1234 {card} 99": ["card"],
        f"{iban} BIC": ["iban"], "BE68539007547034 EUR": ["iban"], f"AB12 {iban}": ["iban"], f"{iban} {card}": ["iban", "card"],
        f"AT61 1904 3002 3457 3201 {card}": ["iban", "card"], f"{card} 123-45-6789": ["card", "ssn"], f"12 2024-02-29 {card}": ["date", "card"],
        f"{card} 10.1.2.3": ["card", "ip"], f"{card} 2024-02-29T10": ["card"], f"{card} 7joe@x.org": ["card", "email"],
        f"+1 (017) 555-7713 {card}": ["phone", "card"], "4111111111111111-5": ["card"], "12 4111 1111 1111 1112 7": [],
    }
    for (text, kinds), (new, got) in zip(texts.items(), replaced(spark, list(texts))):
        assert (text, got[: len(kinds)]) == (text, kinds) and (kinds or new == text)
        assert re.sub(r"[A-Za-z0-9]+", "x", new) == re.sub(r"[A-Za-z0-9]+", "x", text)
        for value in (card, iban, card.replace(" ", ""), iban.replace(" ", "")):
            assert value not in new or not kinds
    long = "1 2 3 " * 4000
    assert len(replaced(spark, [long])[0][0]) == len(long)


def test_one_phone_number_in_many_spellings(spark):
    spellings = {
        "4917612345678": ["+49 176 12345678", "+4917612345678", "+49-176-1234-5678", "+49 (176) 1234 5678", "+491 761 234 5678"],
        "12125551234": ["+1 212 555 1234", "+12125551234", "+1 (212) 555-1234", "(212) 555-1234", "212-555-1234"],
        "35312345678": ["+353 1234 5678", "+35312345678", "+353-1234-5678"],
    }
    every = replaced(spark, [t for texts in spellings.values() for t in texts])
    for whole, texts in spellings.items():
        got, every = every[: len(texts)], every[len(texts) :]
        assert [kinds for _, kinds in got] == [["phone"]] * len(texts)
        digits = {re.sub(r"\D", "", new)[-10:] for new, _ in got}
        assert len(digits) == 1 and whole[-10:] not in digits
        code = {"4": "49", "1": "1", "3": "353"}[whole[0]]
        assert all(re.sub(r"\D", "", new).startswith(code) for (new, _), text in zip(got, texts) if text[0] == "+")


def test_a_key_is_demanded(spark):
    with pytest.raises(TypeError):
        pseudonymise(spark.createDataFrame([], "doc_id long, text string"))
