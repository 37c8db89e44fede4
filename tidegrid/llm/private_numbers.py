"""Format-preserving pseudonyms for private numbers and dates, in SQL functions alone.

Candidates are found by one pattern and each kind is validated:

=========  ============================================================================
card       13 to 19 digits, single blanks or hyphens between; Luhn check digit
iban       country, two check digits, 11 to 30 letters and digits; remainder 1 by 97
phone      ``+`` and 7 to 15 digits with separators, or the North American forms
ssn        ddd-dd-dddd; area not 000, 666 or 9dd, no group of zeros
ip         four numbers up to 255
date       yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy; a day of the years 1800 to 2199
email      the name before the ``@`` (the domain stays)
=========  ============================================================================

Candidates are taken as long as they go, with the digits that follow, so they may hold a neighbour.
One that fails its check is gone through from left to right: at every start behind a blank the
longest part that ends at a blank or hyphen and is valid counts, and the search goes on behind it.

A valid value is permuted by a keyed Feistel network whose two halves are the halves of its
characters: each digit moves by a keyed hash of the other half, modulo 10, each letter modulo 26,
each number of an address modulo 256. Separators and lengths stay. Cards and IBANs keep valid
check digits: the rest is permuted, and the check digits are worked out anew. Dates are numbered
within the 400 years (146,097 days = 773 * 189) and a generalised Feistel network permutes the
numbers, so a date becomes a date. Equal values (whatever their separators) get equal
pseudonyms in all documents, different ones different; a phone number keeps its calling code, and a North American one is
the same with or without it. The caller must name a key.

All happens in expressions over one row: no shuffle, no Python, whole texts.

Defined cases: NULL stays NULL with no findings; candidates that hold no valid value stay as they
are and are not counted; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import free_name, table

ROUNDS = 8

# fixed values: calling codes of one and of two digits; all others have three
ONE_DIGIT = "17"
TWO_DIGITS = (20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98)

#: Kinds and the forms in which they stand in texts, in order of precedence.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d)",
}
#: Where a run of digits may end: not inside a word, an address or a date.
_END = r"(?![\dA-Za-z@%+_]|[./-]\d)"
#: Further digits behind a value; what belongs to which value is settled by the checks.
_MORE = r"(?:[ -][\d -]*(?<=\d)" + _END + ")?"
_DIGITS = r"(?<![\d-])\d(?:[ -]?\d){12,18}"
SCAN = FORMS | {
    "phone": FORMS["phone"].replace("{1,4}(?!\\d)|", "{1,4}(?!\\d)" + _MORE + "|", 1),
    "iban": FORMS["iban"] + _MORE,
    "card": f"{_DIGITS}{_END}{_MORE}|{FORMS['card']}",
}
ANY = "|".join(SCAN.values())
#: No value is longer than this, separators included.
LONGEST = 48


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _number(text: Column) -> Column:
    return text.cast("long")


def _keyed(key: str, kind: str, turn: Column, text: Column) -> Column:
    """64 hex digits from the key, the kind, the round and one half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), text), 256)


def _draw(digest: Column, i: Column) -> Column:
    """The i-th 16-bit number of a digest, round and round."""
    return F.conv(F.substring(digest, i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _moved(half: Column, digest: Column) -> Column:
    """Every digit and letter of a half moved within its kind."""
    def move(c: Column, i: Column) -> Column:
        code, by = F.ascii(c), _draw(digest, i)
        turn = lambda base, size: F.char(F.lit(base) + (code - base + by) % size)
        return F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, 26)) \
            .when(code.between(65, 90), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(_chars(half), move), "")


def _feistel(left: Column, right: Column, step, rounds: int = ROUNDS) -> Column:
    """(l, r) after an even number of rounds of l, r = r, step(l, r, round)."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(left.alias("l"), right.alias("r")),
        lambda s, i: F.struct(s["r"].alias("l"), step(s["l"], s["r"], i).alias("r")))


def permuted(text: Column, key: str, kind: str) -> Column:
    """Digits and letters of a text permuted in place; a bijection on texts of one shape."""
    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    done = _feistel(left, right, lambda l, r, i: _moved(l, _keyed(key, kind, i, r)))
    return F.concat(done["l"], done["r"])


def _refilled(shape: Column, values: Column) -> Column:
    """The digits and letters of ``shape`` replaced one by one by the characters of ``values``."""
    def fill(s: Column, c: Column) -> Column:
        takes = F.ascii(c).between(48, 57) | F.ascii(c).between(65, 90) | F.ascii(c).between(97, 122)
        return F.struct(
            F.concat(s["out"], F.when(takes, F.substring(values, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["n"] + F.when(takes, 1).otherwise(0)).alias("n"))

    return F.aggregate(_chars(shape), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), fill)["out"]


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits whose last one is the check digit."""
    def add(total: Column, x: Column) -> Column:
        return total + x

    weighted = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(weighted, F.lit(0), add)


def _card(text: Column, key: str) -> Column:
    digits = _bare(text)
    body = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return _refilled(text, F.concat(body, check.cast("string")))


def _by_97(text: Column) -> Column:
    """The remainder by 97 of digits and letters (A as 10 and so on)."""
    return F.aggregate(_chars(text), F.lit(0), lambda r, c: F.when(
        F.ascii(c) >= 65, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97).cast("int"))


def _iban(text: Column, key: str) -> Column:
    bare = _bare(text)
    country, body = F.substring(bare, 1, 2), permuted(F.substring(bare, F.lit(5), F.length(bare)), key, "iban")
    check = F.lpad((98 - _by_97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return _refilled(text, F.concat(country, check, body))


def _phone(text: Column, key: str) -> Column:
    digits = _bare(text)
    # the calling code stays, wherever the separators stand
    two = F.substring(digits, 1, 2).isin(*[str(c) for c in TWO_DIGITS])
    code = F.when(F.substring(digits, 1, 1).isin(*ONE_DIGIT), 1).when(two, 2).otherwise(3)
    front = F.when(F.startswith(text, F.lit("+")), code).otherwise(0)
    return _refilled(text, F.concat(
        F.substring(digits, F.lit(1), front), permuted(F.substring(digits, front + 1, F.length(digits)), key, "phone")))


def _ip(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("int"))

    def step(left: Column, right: Column, i: Column) -> Column:
        digest = _keyed(key, "ip", i, F.concat_ws(".", F.transform(right, lambda p: p.cast("string"))))
        return F.transform(left, lambda p, k: (p + _draw(digest, k)) % 256)

    done = _feistel(F.slice(parts, 1, 2), F.slice(parts, 3, 2), step)
    return F.concat_ws(".", F.transform(F.concat(done["l"], done["r"]), lambda p: p.cast("string")))


FIRST_DAY, DAYS = "1800-01-01", 146_097
HIGH, LOW = 773, 189


def _as_date(text: Column) -> Column:
    """The day that a text names, NULL where there is none."""
    iso = F.when(F.substring(text, 5, 1) == "-", text).otherwise(
        F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
    return F.try_to_date(iso, "yyyy-MM-dd")


def _date(text: Column, key: str) -> Column:
    number = F.date_diff(_as_date(text), F.to_date(F.lit(FIRST_DAY)))

    def step(left: Column, right: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, HIGH).otherwise(LOW)
        by = F.conv(F.substring(_keyed(key, "date", i, right.cast("string")), 1, 8), 16, 10).cast("long")
        return ((left + by) % size).cast("int")

    # the halves change places each round, and with them the size of what is moved
    done = _feistel(F.floor(number / LOW).cast("int"), (number % LOW).cast("int"), step)
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (done["l"] * LOW + done["r"]).cast("int"))
    slashed = F.when(F.substring(text, 3, 1) == "/", F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return F.when(F.substring(text, 5, 1) == "-", F.date_format(day, "yyyy-MM-dd")).otherwise(slashed)


def _email(text: Column, key: str) -> Column:
    name = F.substring_index(text, "@", 1)
    return F.concat(permuted(name, key, "email"), F.substring(text, F.length(name) + 1, F.length(text)))


def kind_of(text: Column) -> Column:
    """The kind of a candidate, NULL where it fails its check."""
    bare = _bare(text)
    whole = lambda kind: text.rlike(f"^(?:{FORMS[kind]})$")
    small = F.forall(F.split(text, r"\."), lambda p: p.cast("int") <= 255)
    in_years = _as_date(text).between(F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit("2199-12-31")))
    real_ssn = ~text.rlike(r"^(000|666|9\d\d)|-00-|-0000$")
    return (
        F.when(F.contains(text, F.lit("@")), F.lit("email"))
        .when(whole("ip"), F.when(small, F.lit("ip")))
        .when(whole("date"), F.when(in_years, F.lit("date")))
        .when(whole("ssn"), F.when(real_ssn, F.lit("ssn")))
        .when(whole("phone"), F.when(F.length(bare).between(7, 15), F.lit("phone")))
        .when(whole("iban"), F.when(_by_97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1, F.lit("iban")))
        .when(whole("card"), F.when(luhn_sum(bare) % 10 == 0, F.lit("card")))
    )


def values_in(text: Column) -> Column:
    """The parts (t, kind) of a candidate in order; kind is NULL for what is no valid value."""
    def longest(window: Column) -> Column:
        """The last place where the window's first value may end, with its kind; only cards may end at a hyphen."""
        def mark(end: Column) -> Column:
            after = F.substring(window, end + 1, F.lit(1))
            return F.struct(end.alias("end"), F.when(after.isin("", " ", "-"), kind_of(F.substring(window, F.lit(1), end))).alias("kind"), after.alias("after"))

        marks = F.transform(F.sequence(F.lit(1), F.least(F.length(window), F.lit(LONGEST))), mark)
        # North American numbers have eleven digits; others may be long, and the longest counts
        eleven = lambda end: ~window.rlike(r"^\+1(?!\d)") | (F.length(_bare(F.substring(window, F.lit(1), end))) == 11)
        return F.array_max(F.filter(marks, lambda m: m["kind"].isNotNull() & ((m["after"] != "-") | (m["kind"] == "card"))
                                    & ((m["kind"] != "phone") | eleven(m["end"]))))

    def at(s: Column, start: Column) -> Column:
        def taken(best: Column) -> Column:
            found = F.array(part(F.substring(text, s["next"], start - s["next"]), F.lit(None).cast("string")),
                            part(F.substring(text, start, best["end"]), best["kind"]))
            return F.when(best.isNull(), s).otherwise(
                F.struct((start + best["end"]).alias("next"), F.concat(s["parts"], found).alias("parts")))

        # an array of one: what it holds is worked out once
        window = F.substring(text, start, F.lit(LONGEST + 1))
        return F.when(start < s["next"], s).otherwise(F.transform(F.transform(F.array(window), longest), taken)[0])

    part = lambda t, kind: F.struct(t.alias("t"), kind.alias("kind"))
    starts = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: (F.substring(text, i, F.lit(1)) != " ") & (
        (i == 1) | (F.substring(text, i - 1, F.lit(1)) == " ")))
    begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<t:string,kind:string>>").alias("parts"))
    rest = lambda s: F.array(part(F.substring(text, s["next"], F.length(text)), F.lit(None).cast("string")))
    return F.transform(F.array(kind_of(text)), lambda whole: F.when(whole.isNotNull(), F.array(part(text, whole))).otherwise(
        F.aggregate(starts, begin, at, lambda s: F.concat(s["parts"], rest(s)))))[0]


def pseudonym(text: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(text, key)).when(kind == "ip", _ip(text, key)).when(kind == "date", _date(text, key))
        .when(kind == "ssn", _refilled(text, permuted(_bare(text), key, "ssn"))).when(kind == "phone", _phone(text, key))
        .when(kind == "iban", _iban(text, key)).when(kind == "card", _card(text, key)).otherwise(text)
    )


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", kinds_col: str = "kinds") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and the kinds found, in order, in ``kinds_col``.

    Whoever has the key can undo them: keep it out of sources and plans that others see.
    """
    text = F.col(f"`{text_col}`")
    names = {n: free_name(docs, f"pii_{n}") for n in ("found", "judged")}
    kinds = free_name(docs, kinds_col)
    could = text.rlike("[0-9@]")
    found = docs.withColumn(names["found"], F.when(could, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(
        F.array().cast("array<string>")))
    judged = found.withColumn(names["judged"], F.transform(names["found"], values_in))
    # the text between candidates, then each candidate
    between = F.split(text, ANY, -1)
    new = F.transform(names["judged"], lambda parts: F.array_join(F.transform(parts, lambda x: pseudonym(x["t"], x["kind"], key)), ""))
    rebuilt = F.array_join(F.flatten(F.transform(
        F.arrays_zip(between.alias("a"), new.alias("b")), lambda z: F.array(z["a"], F.coalesce(z["b"], F.lit(""))))), "")
    return (
        judged.withColumn(kinds, F.coalesce(F.filter(F.transform(F.flatten(names["judged"]), lambda x: x["kind"]), lambda k: k.isNotNull()),
                                            F.array().cast("array<string>")))
        .withColumn(text_col, F.when(F.size(kinds) > 0, rebuilt).otherwise(text))
        .select(*[F.col(f"`{c}`") for c in docs.columns], kinds)
    )


#: The key of the registered query, which anyone may check.
KEY = "op8_private_numbers"


def op8_private_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, KEY).select("doc_id", "text", "kinds", F.size("kinds").cast("long").alias("n_found"))
