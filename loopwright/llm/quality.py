"""Quality rules by divergence from language references.

A document's histogram of character classes and its histogram of common words are compared to those of its
language by Jensen-Shannon distance (base 2: 0 same, 1 disjoint). Most words are in the last bin of the second, so that
a text without a single common word is still near. Therefore the share of the own language's common words is compared
too, as a distance in parts of that of a text without any: 0 is the language's share, 1 is none. The word distance is
the larger of both. A text shorter than the guards isn't judged by a histogram that its length can't fill. Base rules
come first: fewer than 50 words, or more than half of the words in repeated windows of three.

A reference is pooled over all documents of the language that pass the base rules, on top of a fixed prior of some 2,000 words and 10,000
characters: what fails the base rules doesn't shift it, and a language with a handful of documents is compared to the prior rather than to
itself. Languages without a list of common words, and null, share a pool for characters; such a text is judged by
the nearest of all references of characters, and its words aren't judged.

Only DataFrame functions are used. References are sums of a fixed number of bins for a fixed set of languages, so they are
collected and compiled into the plan as literals. No shuffle but that of these sums.

Defined results: null and empty texts have no words and fail the base rules; repeated rows are judged each; a null doc_id is kept; an
empty table gives no rows; extra columns, whatever their names, are ignored by judge() and kept by keep().
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, let, materialise, text_or_empty, unpacked, with_row
from loopwright.llm.textstats import ALL_COMMON, CHAR_BINS, COMMON_WORDS, char_histogram, listed_words, with_counts, word_histogram

#: The pool of languages without a list.
OTHER = "*"
# Fixed values of the prior: characters by class (as in CHAR_BINS), words, and the share of them that are listed, falling with the rank.
PRIOR_CHARS = [7700, 300, 100, 1600, 250, 50]
PRIOR_WORDS, PRIOR_SHARE = 2000, 0.3


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_char_distance: float = 0.2
    max_word_distance: float = 0.45
    #: Guards: shorter texts aren't judged by the histogram.
    min_chars: int = 200
    min_histogram_words: int = 80
    #: A share is compared where the text's language would have so many common words in it.
    min_expected_common: int = 8


@dataclass(frozen=True)
class Reference:
    chars: list[float]
    words: dict[str, float]
    all_words: float

    def share(self, listed: list[str]) -> float:
        return sum(self.words.get(w, 0.0) for w in listed) / self.all_words


def language_key(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def prior(key: str) -> Reference:
    listed = COMMON_WORDS.get(key, [])
    weight = [1 / (rank + 2) for rank in range(len(listed))]
    return Reference(list(map(float, PRIOR_CHARS)), {w: PRIOR_WORDS * PRIOR_SHARE * x / sum(weight) for w, x in zip(listed, weight)}, float(PRIOR_WORDS))


def references(counted: DataFrame, rules: Rules = Rules()) -> dict[str, Reference]:
    """The reference of each listed language and of all others: the prior, and sums over the documents that pass the base rules."""
    good = counted.where(~base_failed(rules))
    sums = good.groupBy("key").agg(*[F.sum(F.element_at("chars", i + 1)).alias(f"c{i}") for i in range(CHAR_BINS)], F.sum("n_words").alias("n")).collect()
    # at most len(ALL_COMMON) rows a language
    spelled = good.select("key", F.explode("common").alias("x")).groupBy("key", "x.word").agg(F.sum("x.n").alias("n")).collect()
    found = {}
    for key in [*COMMON_WORDS, OTHER]:
        own, start = next((r for r in sums if r["key"] == key), None), prior(key)
        words = dict(start.words)
        for r in spelled:
            if r["key"] == key:
                words[r["word"]] = words.get(r["word"], 0.0) + r["n"]
        found[key] = Reference([c + (own[f"c{i}"] if own else 0) for i, c in enumerate(start.chars)], words, start.all_words + (own["n"] if own else 0))
    return found


def _half(x: Column, m: Column) -> Column:
    return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))


def _divergence(p: Column, q: Column) -> Column:
    """A bin's part of the Jensen-Shannon divergence, less the part it would have with p = 0."""
    m = (p + q) / 2
    return (_half(p, m) + _half(q, m)) / 2 - q / 2


def _root(divergence: Column) -> Column:
    """The distance: bins with p = 0 have half of q in all, which is 1."""
    return F.sqrt(F.greatest(divergence + 0.5, F.lit(0.0)))


def char_distance(counts: Column, reference: Reference) -> Column:
    whole = sum(reference.chars)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x).cast("double")
    q = F.array(*[F.lit(c / whole) for c in reference.chars])
    return let(total, lambda n: _root(F.aggregate(F.zip_with(counts, q, lambda c, r: _divergence(c / n, r)), F.lit(0.0), lambda acc, x: acc + x)))


def word_distance(histogram: Column, n_words: Column, reference: Reference) -> Column:
    """Over the common words of all languages and the bin of all other words."""
    share = {w: reference.words.get(w, 0.0) / reference.all_words for w in ALL_COMMON}
    q = F.create_map(*[F.lit(x) for w, s in sorted(share.items()) if s > 0 for x in (w, s)]) if any(share.values()) else F.create_map().cast("map<string,double>")
    n = n_words.cast("double")
    rest = _divergence((n_words - listed_words(histogram)) / n, F.lit(1 - sum(share.values())))
    return _root(F.aggregate(F.transform(histogram, lambda x: _divergence(x["n"] / n, F.coalesce(F.try_element_at(q, x["word"]), F.lit(0.0)))), rest, lambda acc, x: acc + x))


def _distance(p: float, q: float) -> float:
    """Jensen-Shannon distance of two shares."""
    half = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    terms = [half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in ((p, q), (1 - p, 1 - q))]
    return math.sqrt(max(sum(terms) / 2, 0.0))


def share_distance(histogram: Column, n_words: Column, reference: Reference, listed: list[str], min_expected: int) -> Column:
    """Distance of the share of the language's own common words, in parts of that of a text without any; null below the guard."""
    q = reference.share(listed)
    p = listed_words(histogram, listed) / n_words.cast("double")
    apart = _root(_divergence(p, F.lit(q)) + _divergence(1 - p, F.lit(1 - q))) / _distance(0.0, q)
    return F.when(n_words * q >= min_expected, apart)


def verdict(df: DataFrame, refs: dict[str, Reference], rules: Rules) -> DataFrame:
    """Adds char_distance, word_distance (null below the guards), base_failed and kept to rows with counts and histograms."""
    chars, common, n = F.col("chars"), F.col("common"), F.col("n_words")
    by_char = F.least(*[char_distance(chars, refs[key]) for key in sorted(refs)])
    by_word = F.lit(None).cast("double")
    for key, listed in COMMON_WORDS.items():
        ref = refs[key]
        by_char = F.when(F.col("key") == key, char_distance(chars, ref)).otherwise(by_char)
        by_word = F.when(F.col("key") == key, F.greatest(word_distance(common, n, ref), share_distance(common, n, ref, listed, rules.min_expected_common))).otherwise(by_word)
    df = df.withColumn("char_distance", F.when(F.col("word_chars") >= rules.min_chars, by_char)).withColumn("word_distance", F.when(n >= rules.min_histogram_words, by_word))
    df = df.withColumn("base_failed", base_failed(rules))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= rules.max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= rules.max_word_distance)
    return df.withColumn("kept", ~F.col("base_failed") & near)


def _counted(df: DataFrame) -> DataFrame:
    df = with_counts(df)
    return df.withColumn("chars", char_histogram(F.col("text"), F.col("word_chars"), F.col("residue"))).withColumn("common", word_histogram(F.col("ws"))).drop("ws", "residue", "text")


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, counts, distances, base_failed and kept of every document. The texts are scanned once."""
    df = chosen(docs, doc_id=id_col, text=text_col, lang=lang_col).select("doc_id", text_or_empty().alias("text"), language_key(F.col("lang")).alias("key"))
    counted = materialise(_counted(df))
    return verdict(counted, references(counted, rules), rules).drop("chars", "common", "key")


def keep(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The kept documents with all their columns. The texts are scanned once; rows with their counts are a table, which the verdict reads.

    A verdict straight over the scan would have the filter's pushed-down form work the words out again at each place that names them.
    """
    df = with_row(docs, text=text_col, lang=lang_col).select("row", text_or_empty().alias("text"), language_key(F.col("lang")).alias("key"))
    counted = materialise(_counted(df))
    return unpacked(verdict(counted, references(counted, rules), rules).where("kept"), docs)
