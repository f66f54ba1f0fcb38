"""Counts of a text that the quality operators share, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import SPACE_CHARS, let, words

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"

# Frequent function words of each language, about in order of frequency.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "on", "be", "by", "are", "at", "from", "this", "have", "or", "an", "not", "which", "but", "had", "they", "his", "you", "were", "all", "their"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "ce", "pas", "il", "se", "plus", "sont", "avec", "ne", "aux", "son", "mais", "ou", "elle", "nous"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "werden", "aus", "er", "hat", "dass", "sie", "nach", "wird", "bei"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "es", "como", "más", "o", "pero", "sus", "le", "ha", "me", "si", "sin", "sobre"],
}
ALL_COMMON = sorted({w for ws in COMMON_WORDS.values() for w in ws})
LONGEST = max(map(len, ALL_COMMON))
#: Bins of the character histogram: lower-case and other letters, upper-case letters, digits, spaces, punctuation, all others.
CHAR_BINS = 6


def char_histogram(text: Column, word_chars: Column, residue: Column) -> Column:
    """`residue` is the text without letters and spaces."""
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("bigint")
    parts = F.struct(
        F.length(text).alias("n"), (F.length(text) - word_chars).alias("s"), count(text, r"\p{Lu}").alias("u"), F.length(residue).alias("r"), count(residue, r"\p{Nd}").alias("d"),
        (F.length(residue) - F.length(F.translate(residue, PUNCTUATION, ""))).alias("p"),
    )
    return let(parts, lambda x: F.array(x["n"] - x["s"] - x["r"] - x["u"], x["u"], x["d"], x["s"], x["p"], x["r"] - x["d"] - x["p"]).cast("array<bigint>"))


def word_histogram(ws: Column) -> Column:
    """(word, n) of the common words of any language that a text has, in lower case and without punctuation around them."""
    bare = F.transform(F.filter(ws, lambda w: F.length(w) <= LONGEST + 2), lambda w: F.lower(F.trim(w, F.lit(PUNCTUATION))))
    found = F.filter(bare, lambda w: w.isin(*ALL_COMMON))
    return let(found, lambda ws: F.transform(F.array_distinct(ws), lambda w: F.struct(w.alias("word"), (F.size(ws) - F.size(F.array_remove(ws, w))).cast("bigint").alias("n"))))


def listed_words(histogram: Column, listed: list[str] | None = None) -> Column:
    """How many words of a histogram are in a list, or in any."""
    kept = histogram if listed is None else F.filter(histogram, lambda x: x["word"].isin(*listed))
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])


def _next(xs: Column, of: Column) -> Column:
    """The array moved on by one: each element meets the one after it in a zip_with, the last a null."""
    return F.slice(xs, 2, F.greatest(F.size(of), F.lit(1)))


def repeated_words(ws: Column, window: int = 3) -> Column:
    """Number of words inside windows of so many words that the text has twice or more, the first included. Exact.

    Windows are sorted by hash, with their position in the low bits, so that equal ones are neighbours. Those with a
    neighbour of their hash are candidates; they are sorted again by their words, and only equal words count. So what
    bits a long text leaves to the hash costs time at worst.
    """
    n = F.size(ws) - (window - 1)

    def hashes(hw: Column) -> Column:
        out = hw
        for k in range(1, window):
            out = F.zip_with(F.slice(out, 1, n), F.slice(hw, k + 1, n), lambda a, b: F.xxhash64(a, b))
        return out

    def candidates(hw: Column, bits: Column) -> Column:
        shifted = F.sort_array(F.transform(hashes(hw), lambda x, i: F.call_function("shiftleft", x, bits) + i))
        pair = lambda a, b: F.when(F.call_function("shiftrightunsigned", a.bitwiseXOR(b), bits) == 0, F.array(a, b))
        alike = F.flatten(F.filter(let(shifted, lambda xs: F.zip_with(xs, _next(xs, xs), pair)), lambda x: x.isNotNull()))
        # the position is what is left without the hash
        return F.array_distinct(F.transform(alike, lambda x: x - F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)))

    def starts(at: Column) -> Column:
        spelled = F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(ws, i.cast("int") + 1, window), " ").alias("w"), i.alias("i"))))
        equal = lambda xs: F.filter(F.zip_with(xs, _next(xs, xs), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
        return F.sort_array(F.array_distinct(F.flatten(let(spelled, equal))))

    def covered(at: Column) -> Column:
        width = F.lit(window).cast("bigint")
        steps = F.zip_with(at, _next(at, at), lambda a, b: F.least(width, F.coalesce(b - a, width)))
        return F.aggregate(F.slice(steps, 1, F.size(at)), F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    counted = lambda at: F.when(F.size(at) == 0, F.lit(0).cast("bigint")).otherwise(let(starts(at), covered))
    parts = F.struct(F.transform(ws, lambda w: F.xxhash64(w)).alias("hw"), F.length(F.bin(n)).alias("bits"))  # bits: enough for a position
    found = let(parts, lambda p: candidates(p["hw"], p["bits"]))
    return F.when(F.size(ws) <= window, F.lit(0).cast("bigint")).otherwise(let(found, counted))


def with_counts(df: DataFrame) -> DataFrame:
    """Adds ws, residue, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for the column `text` (never null)."""
    text = F.col("text")
    residue = F.regexp_replace(text, r"[\p{L} \t\n\x0B\f\r]+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    df = df.withColumn("ws", words(text)).withColumn("residue", residue).withColumn("lines", F.when(text.contains("\n"), lines).otherwise(F.array().cast("array<string>")))
    return df.select(
        *[c for c in df.columns if c != "lines"],
        F.size("ws").cast("bigint").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("bigint").alias("word_chars"),
        (F.length("residue") - F.length(F.translate("residue", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
    )
