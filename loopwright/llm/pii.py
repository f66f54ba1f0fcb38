"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Kinds of the base: email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (+, 10 to 15 digits).
A confirmed base span always stays. The method adds: iban (the country's length, mod 97), card13 (13 digits, Luhn, a word for a card before
it), phone_local (ten digits in the usual 3-3-4 form, a word for a telephone before it) and secret (32 to 64 hexadecimal digits, a word for
a key before them). A span's score is that of its kind, raised by a telling word in the gap before it (its last 40 characters), lowered by
a word that tells of something else; added spans need a score of 0.5, and callers can set a threshold for all by the score that each span carries.

Only DataFrame functions are used. A pattern is applied twice, to extract its matches and to split the text
around them; the running sums of the lengths of both are the spans in code points. Everything is linear in
the text's length: the patterns are possessive where backtracking could not succeed, and anchored so that a
run of characters is tried once. One scan, no shuffle.

Defined results: null and empty texts have no spans; repeated rows are judged each; a null doc_id is kept; spans of different kinds may
overlap; an empty table gives no rows; extra columns, whatever their names, are ignored here and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, let, place, prefix_greatest, prefix_sums, text_or_empty, unpacked, with_row

# The base patterns, leftmost and non-overlapping, in a form that never tries a run of characters twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an account number by country, as registered.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Groups of four up to the country's length, so that a word or number after it isn't taken in; the general form for countries without a length."""

    def of_length(n: int, countries: str) -> str:
        fours, rest = divmod(n - 4, 4)
        return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")

    listed = "|".join(c.replace(" ", "|") for c in IBAN_COUNTRIES.values())
    general = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*(of_length(n, c) for n, c in IBAN_COUNTRIES.items()), general])})(?![A-Za-z0-9])"


IBAN = _iban_pattern()
PHONE_LOCAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"

#: Before the patterns, a cheap test that a text could hold a match.
HINTS = {"email": "@", "phone": "+"}
HINT = "[0-9]{2}|[0-9][. -][0-9]"

PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "phone_local": PHONE_LOCAL, "secret": SECRET}
BASE = ("email", "ip", "card", "phone")
#: Kind: score without context, words that raise it, words that lower it.
CONTEXT = {
    "email": (0.9, r"(?i)\b(?:e-?mail|contact|mail|write)\b", r"(?i)\b(?:example|sample)\b"),
    "ip": (0.6, r"(?i)\b(?:ip|host|address|server|client)\b", r"(?i)\b(?:version|release|section|chapter)\b"),
    "card": (0.7, r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta)\b", r"(?i)\b(?:order|isbn|serial|invoice|tracking)\b"),
    "phone": (0.8, r"(?i)\b(?:tel|telephone|phone|call|fax|mobile)\b", r"(?i)\b(?:score|ratio)\b"),
    "iban": (0.6, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", r"(?i)\b(?:serial|part|model)\b"),
    "card13": (0.3, r"(?i)\b(?:card|visa|credit|debit|carte|karte|tarjeta)\b", r"(?i)\b(?:order|isbn|serial|invoice|tracking)\b"),
    "phone_local": (0.3, r"(?i)\b(?:tel|telephone|phone|call|fax|mobile)\b", r"(?i)\b(?:score|ratio)\b"),
    "secret": (0.3, r"(?i)\b(?:token|key|secret|password|passwd|bearer)\b", r"(?i)\b(?:commit|checksum|digest|md5|sha1|sha256)\b"),
}
RAISE, LOWER, NEEDED, GAP = 0.3, 0.2, 0.5, 40
KINDS = [*BASE, "iban", "card13", "phone_local", "secret"]


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's check of a string of digits: every second digit from the right is doubled and its digits summed."""
    reverse = F.reverse(number)
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))
    doubled = F.translate(reverse, "0123456789", "0246813579")
    digit = lambda i: F.when(i % 2 == 0, F.substring(doubled, i, F.lit(1))).otherwise(F.substring(reverse, i, F.lit(1))).cast("int")
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0


def mod97(match: Column) -> Column:
    """The ISO 7064 check of an account number: first four characters to the end, letters as 10 to 35, remainder 1."""
    joined = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(joined, 5, 40), F.substring(joined, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    step = lambda acc, c: (acc * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _between(c: Column, low: int, high: int) -> Column:
    return (F.length(c) >= low) & (F.length(c) <= high)


def _kind(kind: str, match: Column) -> Column:
    """The kind that a match of a pattern is confirmed as, or null."""
    if kind == "email":
        return F.lit("email")
    if kind == "ip":
        return F.when(match.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?(?:\.|$)){4}$"), F.lit("ip"))
    if kind == "card":
        number = digits(match)
        return F.when(_between(number, 13, 19), F.when(luhn(number), F.when(F.length(number) == 13, F.lit("card13")).otherwise(F.lit("card"))))
    if kind == "phone":
        return F.when(_between(digits(match), 10, 15), F.lit("phone"))
    if kind == "iban":
        return F.when(_between(F.replace(match, F.lit(" "), F.lit("")), 15, 34), F.when(mod97(match), F.lit("iban")))
    return F.lit(kind)


def _score(kind: Column, gap: Column) -> Column:
    near = F.right(gap, F.lit(GAP))
    score = F.lit(0.0)
    for name, (start, up, down) in CONTEXT.items():
        own = F.lit(start) + F.when(near.rlike(up), F.lit(RAISE)).otherwise(F.lit(0.0)) - F.when(near.rlike(down), F.lit(LOWER)).otherwise(F.lit(0.0))
        score = F.when(kind == name, own).otherwise(score)
    return F.round(F.least(score, F.lit(1.0)), 2)


def _nothing(kind: str) -> Column:
    return F.array().cast(kind)


def _matches(kind: str, text: Column) -> Column:
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike(HINT)
    return F.when(hint, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(_nothing("array<string>"))


def _proposed(df: DataFrame, kind: str, text: Column) -> DataFrame:
    """Adds m_kind, the matches, and g_kind, the text around them (one more), both empty without a match."""
    df = df.withColumn(f"m_{kind}", _matches(kind, text))
    return df.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split(text, PATTERNS[kind], -1)).otherwise(_nothing("array<string>")))


_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,text:string>>"


def _confirmed(kind: str) -> Column:
    """The confirmed spans of a pattern as (start, rank, kind, end, score, text)."""
    matches, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    ends = prefix_sums(F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: (F.length(m) + F.length(g)).cast("bigint")))
    parts = F.zip_with(F.arrays_zip(matches.alias("m"), gaps.alias("g")), ends, lambda x, end: F.struct(x["m"].alias("m"), x["g"].alias("g"), end.alias("end")))
    found = F.transform(F.slice(parts, 1, F.size(matches)), lambda x: F.struct(x["m"].alias("m"), x["g"].alias("g"), x["end"].alias("end"), _kind(kind, x["m"]).alias("kind")))
    scored = F.transform(F.filter(found, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["m"].alias("m"), x["end"].alias("end"), x["kind"].alias("kind"), _score(x["kind"], x["g"]).alias("score")))
    ranks = F.array(*map(F.lit, KINDS))
    kept = F.filter(scored, lambda x: x["kind"].isin(*BASE) | (x["score"] >= NEEDED))
    spans = F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), F.array_position(ranks, x["kind"]).cast("int").alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"), x["score"].alias("score"), x["m"].alias("text")))
    return F.when(F.size(matches) > 0, spans).otherwise(_nothing(_SPAN))


def _with_spans(df: DataFrame) -> DataFrame:
    """Adds spans to rows with a column text."""
    columns = df.columns
    for kind in PATTERNS:
        df = _proposed(df, kind, F.col("text"))
    return df.select(*columns, F.array_sort(F.flatten(F.array(*[_confirmed(kind) for kind in PATTERNS]))).alias("spans"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (start, rank, kind, end, score, text), by start, then kind. End exclusive, in code points."""
    df = chosen(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("text"))
    return _with_spans(df).select("doc_id", "spans")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _unions(spans: Column, reach: Column) -> Column:
    """start, end and kind (that of its first span) of each stretch that spans cover; spans that only touch are two. reach: the greatest end so far, a span each."""
    opens = F.filter(F.transform(spans, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda s: (s["i"] == 0) | (s["start"] >= F.get(reach, s["i"] - 1)))
    last = lambda xs: F.transform(xs, lambda s, i: F.struct(s["start"].alias("start"), F.get(reach, F.coalesce(F.get(xs, i + 1)["i"], F.size(reach)) - 1).alias("end"), s["kind"].alias("kind")))
    return let(opens, last)


def _cut(chars: Column, unions: Column) -> Column:
    """The characters with each union replaced by its kind."""
    before = F.transform(unions, lambda u, i: F.concat(F.array_join(F.slice(chars, F.coalesce(F.get(unions, i - 1)["end"], F.lit(0).cast("bigint")).cast("int") + 1, (u["start"] - F.coalesce(F.get(unions, i - 1)["end"], F.lit(0).cast("bigint"))).cast("int")), ""), F.lit("["), F.upper(u["kind"]), F.lit("]")))
    after = F.element_at(unions, -1)["end"].cast("int")
    return F.concat(F.array_join(before, ""), F.array_join(F.slice(chars, after + 1, F.size(chars)), ""))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with all that the confirmed spans cover replaced by kinds in brackets; all other columns as they are, but `length_col`, if there is one:
    the length of a text that changed.

    Spans are those of find_spans() in the text as it was. Where some overlap, their union is replaced by the kind that starts first (of equal starts the first of KINDS), so no
    character of a span is left. A text without spans, null too, is unchanged.
    """
    rows = _with_spans(with_row(docs, own=text_col).select("row", "own", text_or_empty("own").alias("text")))
    rows = rows.withColumn("reach", prefix_greatest(F.transform("spans", lambda s: s["end"])))
    rows = rows.withColumn("unions", F.when(F.size("spans") > 0, _unions(F.col("spans"), F.col("reach"))))
    cut = let(F.split("text", ""), lambda chars: _cut(chars, F.col("unions")))
    rows = rows.withColumn("clean", F.when(F.col("unions").isNotNull(), cut).otherwise(F.col("own")))
    changed = {text_col: F.col("clean")}
    if length_col is not None and length_col.lower() in [c.lower() for c in docs.columns]:
        i = place(docs, length_col)
        own = F.col("row").getField(f"c{i}")
        changed[length_col] = F.when(F.col("unions").isNotNull(), F.length("clean").cast(docs.schema[i].dataType)).otherwise(own)
    return unpacked(rows, docs, **changed)
