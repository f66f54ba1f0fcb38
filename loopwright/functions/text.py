"""Street names, addresses and export text as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of street suffixes and directions, and their canonical words.
SUFFIXES = {
    "cir": "circle", "circle": "circle", "ln": "lane", "lane": "lane", "dr": "drive", "drive": "drive",
    "ct": "court", "court": "court", "sq": "square", "square": "square", "pl": "place", "place": "place",
    "rd": "road", "road": "road", "ave": "avenue", "av": "avenue", "avenue": "avenue",
    "blvd": "boulevard", "boulevard": "boulevard", "trl": "trail", "trail": "trail",
    "pkwy": "parkway", "pky": "parkway", "parkway": "parkway", "st": "street", "street": "street",
    "ter": "terrace", "terrace": "terrace", "hwy": "highway", "highway": "highway", "way": "way",
}
DIRECTIONS = {
    "n": "north", "north": "north", "s": "south", "south": "south", "e": "east", "east": "east",
    "w": "west", "west": "west", "ne": "northeast", "northeast": "northeast", "nw": "northwest", "northwest": "northwest",
    "se": "southeast", "southeast": "southeast", "sw": "southwest", "southwest": "southwest",
}
#: The normaliser of the evaluation knows one suffix less and drops these words.
EVAL_DROPPED = ["n", "north", "s", "south", "e", "east", "w", "west", "ne", "nw", "se", "sw"]
NO_ADDRESS = "(no address)"
# Fixed values of the two public 32-bit hashes in cache keys.
HASH_START, HASH_OFFSET, HASH_PRIME = 5381, 2166136261, 16777619

_DIRECTION_WORDS = sorted(set(DIRECTIONS.values()))
_SUFFIX_WORDS = sorted(set(SUFFIXES.values()))


def _mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def tokens(s: Column) -> Column:
    """Lower-case words of letters a-z and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(s), r"[^a-z0-9\s]+", " "), r"\s+"), lambda t: t != "")


def _canonical(s: Column) -> Column:
    known = _mapping({**SUFFIXES, **DIRECTIONS})
    return F.transform(tokens(s), lambda t: F.coalesce(F.try_element_at(known, t), t))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalize_street(s: Column) -> Column:
    """Canonical name; a direction after a suffix moves to the front."""

    def ordered(t: Column) -> Column:
        moves = (F.size(t) >= 3) & F.try_element_at(t, F.lit(-1)).isin(_DIRECTION_WORDS) & F.try_element_at(t, F.lit(-2)).isin(_SUFFIX_WORDS)
        return F.when(moves, F.concat(F.slice(t, -1, 1), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))))).otherwise(t)

    return F.array_join(let(_canonical(s), ordered), " ")


def street_base(s: Column) -> Column:
    """Canonical name without directions, unless nothing else is in it."""
    words = F.filter(F.split(normalize_street(s), " "), lambda t: t != "")
    return let(words, lambda t: F.array_join(let(F.filter(t, lambda w: ~w.isin(_DIRECTION_WORDS)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(t)), " "))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; most + 1 where it is more than `most`."""
    if most is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def fuzzy_same_street(a: Column, b: Column) -> Column:
    """Equal, or both of six letters and more, with the same first one, within two edits; never for empty names."""
    near = (F.length(a) >= 6) & (F.length(b) >= 6) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (edit_distance(a, b, 2) <= 2)
    return (a != "") & (b != "") & ((a == b) | near)


def _title(t: Column) -> Column:
    upper = t.rlike(r"\d") | t.rlike(r"(?i)^(N|S|E|W|NE|NW|SE|SW)$") | t.rlike(r"(?i)^(II|III|IV|VI|VII|VIII|IX|XI|XII)$")
    return F.when(t.rlike(r"(?i)^\d+(ST|ND|RD|TH)$"), F.lower(t)).when(upper, F.upper(t)).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30))))


def format_address(raw: Column) -> Column:
    """struct(label, street) of an address in capitals; the street starts after the house number's tokens, the last token stays."""
    words = F.filter(F.split(F.trim(raw), r"\s+"), lambda t: t != "")

    def parted(ws: Column) -> Column:
        number = F.transform(ws, lambda t, i: F.when(t.rlike(r"^\d") & ~t.rlike(r"(?i)^\d+(ST|ND|RD|TH)$") & (i < F.size(ws) - 1), F.lit(0)).otherwise(i + 1))
        first = F.array_min(F.filter(number, lambda i: i > 0))
        titled = F.transform(ws, _title)
        street = F.when(F.size(ws) > 0, F.array_join(F.slice(titled, F.coalesce(first, F.lit(1)), F.greatest(F.size(ws), F.lit(1))), " ")).otherwise(F.lit(""))
        return F.struct(F.array_join(titled, " ").alias("label"), street.alias("street"))

    return let(words, parted)


def eval_norm(s: Column) -> Column:
    """The evaluation's own normaliser: no directions, suffixes spelled out, order kept."""
    known = _mapping({k: v for k, v in SUFFIXES.items() if k != "way"})
    plain = F.filter(F.split(F.regexp_replace(F.lower(s), r"[^a-z0-9 ]+", " "), r"\s+"), lambda t: (t != "") & ~t.isin(EVAL_DROPPED))
    return F.array_join(F.transform(plain, lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


def neutralise(s: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(s.rlike(r"^(?:[=+@\t\r]|-(?!\d))"), F.concat(F.lit("'"), s)).otherwise(s)


def csv_field(s: Column) -> Column:
    return F.when(s.rlike(r'[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def escape_html(s: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    return s


def two_places(x: Column) -> Column:
    """A double to two places as C prints it: rounded by its exact binary value, halves to even. Java's %.2f rounds the shortest decimal that tells the double, half up; from 2 ** 63 on its digits stay."""

    def printed(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size)
        rest = size - whole
        # a hundred times the rest is high + low, both exact: products of 26 bits, and of what is left of 53, by 100
        head = F.floor(rest * (1 << 26)) / (1 << 26)
        high, low = head * 100, (rest - head) * 100
        down = F.floor(high)
        over = (high - down - 0.5) + low
        cents = down + F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1).otherwise(0)
        sign = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
        exact = F.concat(sign, (whole + F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
        return F.when(size < float(1 << 63), exact).when(v.isNotNull(), F.format_string("%.2f", v))

    return let(x.cast("double"), printed)


def format_distance(metres: Column) -> Column:
    """Miles to two places, metres rounded half up; null without metres."""
    return F.concat(two_places(metres / 1609.344), F.lit(" mi ("), F.floor(metres + 0.5).cast("bigint").cast("string"), F.lit(" m)"))


def poly_string(ring: Column) -> Column:
    """'lat lon' of each vertex of an open ring, six decimals."""
    from loopwright.functions.geo import open_ring

    return F.array_join(F.transform(open_ring(ring), lambda v: F.format_string("%.6f %.6f", v["lat"], v["lon"])), " ")


def hash_text(s: Column) -> Column:
    """Two 32-bit hashes (times 33 plus, xor times prime) and the length, all in hexadecimal."""
    unit = F.lit(0xFFFFFFFF).cast("bigint")
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))

    def step(acc: Column, c: Column) -> Column:
        return F.struct((acc["a"] * 33 + c).bitwiseAND(unit).alias("a"), (acc["b"].bitwiseXOR(c) * F.lit(HASH_PRIME)).bitwiseAND(unit).alias("b"))

    start = F.struct(F.lit(HASH_START).cast("bigint").alias("a"), F.lit(HASH_OFFSET).cast("bigint").alias("b"))
    return let(F.aggregate(codes, start, step), lambda h: F.concat(F.lower(F.hex(h["a"])), F.lower(F.hex(h["b"])), F.lit("-"), F.lower(F.hex(F.length(s).cast("bigint")))))


def members_signature(group: Column, members: Column) -> Column:
    """'group:sorted,members'."""
    return F.concat(group.cast("string"), F.lit(":"), F.array_join(F.sort_array(members).cast("array<string>"), ","))


#: The separator of signature parts.
SEPARATOR = "\u0001"


def input_signature(assignment_json: Column, locked: Column, removed: Column, locked_houses: Column) -> Column:
    return F.concat_ws("|", assignment_json, *[F.array_join(c, SEPARATOR) for c in (locked, removed, locked_houses)])


def model_key(house_ids: Column, removed: Column, crossing_penalty: Column) -> Column:
    return F.concat_ws("|", F.array_join(house_ids, SEPARATOR), F.array_join(removed, SEPARATOR), crossing_penalty.cast("string"))
