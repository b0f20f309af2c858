"""Personal data in texts (DataFrame functions only).

Regular expressions propose spans; checksums (Luhn for cards, mod-97 for bank account numbers) and range rules confirm
them; words near a span adjust its score. Spans are code points, end exclusive.

The base kinds email, ip, card and phone are found leftmost and without overlap inside a kind, and stay whatever their
score. The method adds bank accounts (iban, confirmed by mod-97), identity numbers (ssn), access keys of a known form, and
secrets (long words with letters and digits), which need a score of `threshold`: their prior plus `CONTEXT_GAIN` if a
context word stands within `CONTEXT_CHARS` before them.

Matching takes linear time on texts of any length: a run that fails is not tried again from its middle (look-behind),
and runs are possessive where no shorter match could succeed.

Defined results: null text counts as empty and has no spans; repeated rows give repeated results; an empty table gives
an empty table; very long texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,128}(?![A-Za-z0-9_-])"
# Words near a span that speak for it.
CONTEXT_WORDS = {
    "email": ["mail", "contact", "correo"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"],
    "phone": ["phone", "call", "tel", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social security"],
    "access_key": ["key", "aws", "access"],
    "secret": ["token", "secret", "password", "passwd", "api key", "api_key", "apikey", "bearer"],
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "access_key": 0.8, "secret": 0.3}
CONTEXT_CHARS, CONTEXT_GAIN = 40, 0.35
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "access_key", "secret")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    places = F.split(F.reverse(digits), "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, without spaces, leaves 1 modulo 97 in the order that the checksum asks for."""
    turned = F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(value))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    return F.lit(True)


def proposals(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """Array of struct(start, end, value) of the confirmed matches; an empty one where the hint is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a, x):
        begin = a["at"] + x["g"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    spans = F.aggregate(lengths, start, step, lambda a: a["out"])
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(hint, F.filter(spans, lambda s: _confirmed(kind, s["value"]))).otherwise(none)


def scored(text: Column, kind: str, spans: Column) -> Column:
    near = lambda s: F.lower(F.substr(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT_CHARS), F.least(s["start"], F.lit(CONTEXT_CHARS))))
    words = "(?<![a-z])(?:" + "|".join(CONTEXT_WORDS[kind]) + ")"
    score = lambda s: F.lit(PRIOR[kind]) + F.when(near(s).rlike(words), CONTEXT_GAIN).otherwise(0.0)
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), score(s)).alias("score")))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """doc_id, and for each kind an array of struct(kind, start, end, score) in order of start."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    digit = t.rlike("[0-9]")
    hints = {
        "email": (EMAIL, F.contains(t, F.lit("@"))), "ip": (IP, t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
        "phone": (PHONE, F.contains(t, F.lit("+")) & digit), "iban": (IBAN, t.rlike("[A-Z]{2}[0-9]{2}")), "ssn": (SSN, t.rlike("-[0-9]{2}-")),
        "access_key": (ACCESS_KEY, F.contains(t, F.lit("AKIA"))), "secret": (SECRET, F.lower(t).rlike("|".join(CONTEXT_WORDS["secret"]))),
    }
    out = rows.select("doc_id", "t", *[proposals(t, k, p, hint).alias(k) for k, (p, hint) in hints.items()])
    out = out.select("doc_id", *[scored(t, k, F.col(k)).alias(k) for k in hints])
    return out.withColumns({k: F.filter(k, lambda s: s["score"] >= threshold) for k in ADDED_KINDS})


def span_text(*kinds: str) -> Column:
    listed = F.concat(*[F.transform(k, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds])
    return F.array_join(listed, ",")
