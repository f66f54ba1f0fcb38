"""The registered queries of this subpackage, one an operator, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.llm import collocations, fingerprints, manifest, minhash, mixing, packing, pii, quality, ranking, streamdedup, suffixes, tokens, urls
from loopwright.llm.common import table

#: The vocabulary that counting and packing use.
VOCABULARY = "word_bpe_49k.json"

#: The URL rules: action, host and path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_classes(fingerprints.edited(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "copies", "links")


def _spans_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [_spans_of(kind).alias(f"n_{kind}") for kind in pii.BASE]
    added = F.filter("spans", lambda s: ~s["kind"].isin(*pii.BASE))
    more = [F.size(added).cast("bigint").alias("n_added"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_score"), F.array_min(F.transform("spans", lambda s: s["score"])).alias("min_score")]
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"), *more)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def campaign_urls(pages: DataFrame) -> DataFrame:
    """The blocklist of op8: every address that was crawled under a campaign link; its other spellings are the same address."""
    return pages.select("url").where(F.col("url").contains("utm_source="))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, campaign_urls(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents")).drop("proof")


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamdedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_pii": op2_pii,
    "op3_tokens": op3_tokens,
    "op4_quality": op4_quality,
    "op5_suffixes": op5_suffixes,
    "op6_mixing": op6_mixing,
    "op7_ranking": op7_ranking,
    "op8_urls": op8_urls,
    "op9_minhash": op9_minhash,
    "op10_packing": op10_packing,
    "op11_manifest": op11_manifest,
    "op12_exact": op12_exact,
    "op13_phrases": op13_phrases,
}

_OP6 = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sums),
weighed AS (
  SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS lim FROM ranked),
leveled AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM sums) - coalesce(sum(lim) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (rising ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER rising AS place
  FROM weighed WINDOW rising AS (ORDER BY lim / weight, source NULLS LAST)),
held AS (SELECT level AS held_level FROM leveled WHERE level * weight < lim ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, rank, CASE WHEN held_level IS NULL THEN lim ELSE least(lim, held_level * weight) END AS target
  FROM leveled LEFT JOIN held ON true),
placed AS (
  SELECT s.rid, s.doc_id, s.size, s.ord, t.rank, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.ord, s.rid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passed AS (
  SELECT rid, size, ord, rank, pass, (pass * source_size + upto) / target AS finish
  FROM placed, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND target > 0),
summed AS (
  SELECT rid, size, sum(size) OVER (ORDER BY finish, rank, pass, ord, rid ROWS UNBOUNDED PRECEDING) AS upto FROM passed),
taken AS (
  SELECT rid, CAST(sum(size) AS BIGINT) AS taken FROM summed WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY rid)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0) AS taken
FROM placed p LEFT JOIN taken t USING (rid)
"""

_OP8 = r"""
WITH parted AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
named AS (
  SELECT page_id, url, rest,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parted),
canonical AS (
  SELECT page_id, url, host, path,
         list_sort(list_filter(str_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept
  FROM named),
keyed AS (
  SELECT page_id, url, host, path,
         CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key
  FROM canonical),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM keyed),
listed AS (SELECT DISTINCT key FROM keyed WHERE contains(url, 'utm_source=') AND key IS NOT NULL)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def _said(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_levels(prefix: str, first: str, most: int) -> str:
    """Levels 1 to `most` of trees: {prefix}k (tree, place, digest), from `first` (tree, n, place, digest); a tree has no level above its last."""
    levels, before = [], first
    for k in range(1, most + 1):
        levels.append(f"{prefix}{k} AS MATERIALIZED (SELECT tree, n, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {before} WHERE n > {16 ** (k - 1)} GROUP BY tree, n, place // 16)")
        before = f"{prefix}{k}"
    return ",\n".join(levels)


def _op11() -> str:
    leaf = lambda text: f"sha256({' || '.join([_said(c) for c in ('doc_id', 'source', 'lang', 'n_chars')] + [_said(text)])})"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    inner, outer = 5, 3
    parts = []
    for k in range(inner):
        source = "leaves" if k == 0 else f"l{k}"
        parts.append(f"SELECT p.doc, {k} AS step, s.place AS place, s.digest, p.place // {16**k} AS own FROM leaves p JOIN {source} s ON s.tree = p.tree AND s.place // 16 = p.place // {16 ** (k + 1)} WHERE p.n > {16**k}")
    for k in range(outer):
        source = "subroots" if k == 0 else f"t{k}"
        parts.append(f"SELECT p.doc, {inner + k} AS step, s.place AS place, s.digest, p.tree // {16**k} AS own FROM leaves p JOIN {source} s ON s.place // 16 = p.tree // {16 ** (k + 1)} WHERE (SELECT count(*) FROM subroots) > {16**k}")
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, source, {leaf('text')} AS digest,
         {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered, coalesce({crc} % 5 = 0, false) AS hit
  FROM documents),
leaves AS MATERIALIZED (
  SELECT doc, doc_id, digest, CASE WHEN hit THEN lowered ELSE digest END AS changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS place
  FROM docs),
{_sql_levels('l', 'leaves', inner)},
subroots AS MATERIALIZED (
  SELECT -1 AS tree, count(*) OVER () AS n, s.tree AS place, digest FROM (
    SELECT tree, digest FROM leaves WHERE n = 1 {' '.join(f"UNION ALL SELECT tree, digest FROM l{k} WHERE n > {16 ** (k - 1)} AND n <= {16**k}" for k in range(1, inner + 1))}) s),
{_sql_levels('t', 'subroots', outer)},
root AS (SELECT digest FROM (SELECT digest, 0 AS k FROM subroots WHERE n = 1 {' '.join(f"UNION ALL SELECT digest, {k} FROM t{k} WHERE n > {16 ** (k - 1)} AND n <= {16**k}" for k in range(1, outer + 1))})),
asked AS ({' UNION ALL '.join(parts)}),
steps AS (
  SELECT doc, step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS behind
  FROM asked GROUP BY doc, step),
proofs AS (SELECT doc, string_agg(before || behind, '' ORDER BY step) AS siblings, list({{'b': before, 'a': behind}} ORDER BY step) AS steps FROM steps GROUP BY doc)
SELECT doc_id, l.digest AS leaf, s.digest AS subroot, (SELECT digest FROM root) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
       folded AS folded_root, folded = (SELECT digest FROM root) AS verified
FROM (SELECT l.*, p.siblings, CASE WHEN p.steps IS NULL THEN changed ELSE list_reduce(list_prepend({{'b': changed, 'a': ''}}, p.steps), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b END AS folded FROM leaves l LEFT JOIN proofs p USING (doc)) l
JOIN subroots s ON s.place = l.tree
"""


_OP12 = r"""
WITH n AS (
  SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST, rid)
"""

_OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
parts AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
grams AS (
  SELECT lang, size, array_to_string(words[place:place + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS place FROM parts, (SELECT unnest([1, 2, 3, 4]) AS size)) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, str_split(phrase, ' ') AS words FROM grams WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, p.f AS l, q.f AS r, (2000000::HUGEINT * c.a) // (p.f::HUGEINT + q.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN grams p ON p.lang = c.lang AND p.phrase = array_to_string(c.words[1:k], ' ') JOIN grams q ON q.lang = c.lang AND q.phrase = array_to_string(c.words[k + 1:], ' ')),
chosen AS (SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[place:place + part - 1], ' ') AS phrase, max(a) AS cover
  FROM (SELECT *, unnest(range(1, size - part + 2)) AS place FROM (SELECT *, unnest(range(2, size)) AS part FROM candidates)) GROUP BY ALL),
ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(c.phrase)) AS rank, c.phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM chosen c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op6_mixing": _OP6, "op8_urls": _OP8, "op11_manifest": _op11(), "op12_exact": _OP12, "op13_phrases": _OP13}
