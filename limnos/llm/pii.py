"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All work is Spark SQL expressions.  A kind's pattern marks its matches inside
the text with two control characters (those already there are first replaced,
one for one, by another control character, which no pattern matches); the
marked text is split, and running lengths of the pieces give each match its
place in code points.  Patterns are written so that a scan is linear in the
text: quantifiers are possessive and a run is entered at its first character.

Base kinds (each match that fails its check is dropped, and the search goes on behind it):

    email   local@label.label...
    ip      four numbers of at most 255
    card    14 to 19 digits, single spaces or hyphens between, passing Luhn
    phone   + and 10 to 15 digits

Added kinds:

    iban    country, two check digits and as many letters or digits as the country's accounts have
            (11 to 30 for a code without a known length), confirmed by mod 97
    ssn     ddd-dd-dddd, kept only if a context word raises its score to ``THRESHOLD``

Score: the kind's base value, plus ``CHECKED`` if a checksum confirmed it, plus
``NEAR`` if one of the kind's context words lies in the ``WINDOW`` characters
before or after it; at most 1.  Base kinds stay at any score.

Defined results: NULL text counts as empty and has no spans; repeated rows each
get a row; spans of different kinds may overlap; ties in start follow the order
of the kinds above; ``redact`` keeps every column and NULL texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, PLAIN = "\u0001", "\u0002", "\u0003"
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
#: Characters of an account number, by country: the IBAN registry and the countries that use the form without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban_pattern() -> str:
    """A known account ends at its last character, so the words behind it are no part of the match."""
    known = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}"
                     for n, codes in IBAN_LENGTHS.items())
    known = f"(?:{known})(?![A-Za-z0-9])"
    listed = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = f"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]|\\x20(?!{known})[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})"


#: Equal to the stated base patterns: possessive where nothing that follows could use a given-back character.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text in which this is not found has no match of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]"}
CONTEXT = {
    "email": ["email", "e-mail", "mail", "contact"],
    "ip": ["ip", "address", "server", "host"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "call", "tel", "mobile"],
    "iban": ["iban", "account", "bank", "transfer"],
    "ssn": ["ssn", "social", "security"],
}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.3}
CHECKED, NEAR, THRESHOLD, WINDOW = 0.4, 0.2, 0.5, 40
CHECKSUMS = {"card", "iban"}
_FOLD = 128


def _running(lengths: Column) -> Column:
    """Sums of the values before each place; folded in runs, so long arrays stay cheap."""
    def fold(values, first):
        return F.aggregate(
            values, F.struct(first.alias("sum"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")),
            lambda a: a["out"])

    runs = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(_FOLD)),
                       lambda s: F.slice(lengths, s + 1, F.lit(_FOLD)))
    sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(runs, fold(sums, F.lit(0)), fold))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a digit string passes Luhn."""
    ones = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    places = F.transform(ones, lambda x, i: F.when(i % 2 == 0, x).otherwise(
        x * 2 - F.when(x > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number (spaces allowed) leaves 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97)
        .otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike(
            "^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(s))
        return F.when(n.between(14, 19), luhn(_digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(s, " ", "")).between(15, 34), mod97(s)).otherwise(F.lit(False))
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind_spans(kind: str, text: Column) -> Column:
    """array<struct<start,end,kind,rank,score>> of a kind's confirmed matches."""
    marked = F.regexp_replace(text, PATTERNS[kind], OPEN + "$0" + CLOSE)
    words = "|".join(CONTEXT[kind])
    near = f"(?i)(?<![a-z])(?:{words})(?![a-z])"

    def of_pieces(pieces):
        return _let(_running(F.transform(pieces, lambda p: F.length(p))), lambda before: of_places(pieces, before))

    def of_places(pieces, before):
        # odd pieces are the matches; only those that pass are described
        return F.filter(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.when(
            _passes(kind, p), describe(pieces, before, p, i)))), lambda x: x.isNotNull())

    def describe(pieces, before, piece, i):
        left, right = F.get(pieces, i - 1), F.coalesce(F.get(pieces, i + 1), F.lit(""))
        around = F.concat(F.substr(left, F.greatest(F.length(left) - WINDOW + 1, F.lit(1))), F.lit(" | "),
                          F.substr(right, F.lit(1), F.lit(WINDOW)))
        score = F.lit(BASE_SCORE[kind] + (CHECKED if kind in CHECKSUMS else 0.0)) + F.when(
            around.rlike(near), F.lit(NEAR)).otherwise(F.lit(0.0))
        start = F.get(before, i)
        return F.struct(start.cast("long").alias("start"), (start + F.length(piece)).cast("long").alias("end"),
                        F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"),
                        F.round(F.least(score, F.lit(1.0)), 6).alias("score"))

    spans = _let(F.split(marked, f"[{OPEN}{CLOSE}]"), of_pieces)
    if kind == "ssn":
        spans = F.filter(spans, lambda x: x["score"] >= THRESHOLD)
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,rank:int,score:double>>")
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(none)


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array<struct<start,end,kind,rank,score>>, by start, then kind."""
    plain = F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), OPEN + CLOSE, PLAIN + PLAIN)
    spans = F.array_sort(F.concat(*(_kind_spans(kind, plain) for kind in KINDS)), lambda a, b: F.when(
        (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["rank"] < b["rank"])), F.lit(-1)).when(
        (a["start"] == b["start"]) & (a["rank"] == b["rank"]), F.lit(0)).otherwise(F.lit(1)))
    return docs.withColumn(out, spans)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the
    one that starts first (then the earlier kind) is replaced.  NULL texts stay NULL."""
    tmp = "_pii_spans"
    while tmp in docs.columns:
        tmp += "_"
    marked = find_spans(docs, text_col, tmp)
    text, spans = F.col(text_col), F.col(tmp)
    whole = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def between(lo, hi):
        return F.substr(text, (lo + 1).cast("int"), (hi - lo).cast("int"))

    def of_run(a, run):
        return F.aggregate(
            run, F.struct(F.lit("").alias("text"), a["at"].alias("at")),
            lambda b, x: F.when(x["start"] >= b["at"], F.struct(
                F.concat(b["text"], between(b["at"], x["start"]), F.lit("["), F.upper(x["kind"]),
                         F.lit("]")).alias("text"), x["end"].alias("at"))).otherwise(b),
            lambda b: F.struct(F.concat(a["parts"], F.array(b["text"])).alias("parts"), b["at"].alias("at")))

    runs = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(_FOLD)),
                       lambda s: F.slice(spans, s + 1, F.lit(_FOLD)))
    done = F.aggregate(runs, whole, of_run, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substr(text, (a["at"] + 1).cast("int"))))
    clean = F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(done)
    return marked.withColumn(text_col, clean).drop(tmp)
