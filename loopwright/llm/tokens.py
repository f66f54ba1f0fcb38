"""Token counts and ids by the whole-token shortcut.

Offline proof: every vocabulary string that ends a word is decoded and encoded alone; it is a *whole token*
if exactly its own id comes back. In a text, a pre-token that is a whole token costs one dictionary lookup;
only the rest goes through the merges, once per distinct string and worker.

Why counting by pre-token is exact for this kind of tokenizer: its pre-tokenizer never joins characters across
white space, its merges never cross pre-tokens, and its normalizer maps characters one by one, except for
combining marks and a few letters outside Latin. White-space separated chunks with a character outside
Latin-1/Latin Extended-A, and the added special strings, therefore go to the library as they are; everything
else is lower-cased and split here by the tokenizer's own pattern. Stretches between white space are remembered with
their values, so that a frequent one is split once a worker.

A file with another normaliser, splitter or kind of model is given to the library whole.

Defined results: null text counts as empty; an empty text has 0 tokens; repeated rows are counted each; a null doc_id is kept;
texts are processed whole, whatever their length; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, text_or_empty

# Letters, digits and white space among the characters up to U+017F, after lower-casing.
_LETTERS = "a-zªµºß-öø-ſ"
_NUMBERS = "0-9²³¹¼½¾"
_WHITE = "\\t-\\r \\x85\\xa0"

_PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")
#: The same, and the space between chunks.
_SPACED = re.compile(f"{_PRE_TOKENS.pattern}| ")
#: Characters whose normalization or class the splitter above doesn't cover.
_OTHER = re.compile("[^\\x00-\\u012f\\u0131-\\u017f]")
_CHUNKS = re.compile("[ \\t\\n\\r]+")

# The normaliser and pre-tokenizer of the files that the splitter above covers.
NORMALIZERS = [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
PRE_TOKENIZERS = [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)]

#: Distinct strings a worker remembers; beyond it the memory starts anew (counts stay the same).
MEMO_ENTRIES = 500_000
#: As many stretches between white space.
CHUNK_ENTRIES = 800_000
#: Longer strings aren't remembered.
MEMO_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def covered(tokenizer_json: str) -> bool:
    """Whether a file normalises and splits as the splitter here does; any other one is left to the library whole."""
    said = json.loads(tokenizer_json)
    normalizer, splitter, model = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}, said["model"]
    steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in normalizer.get("normalizers", [])]
    parts = [(n["type"], n.get("pattern", {}).get("Regex")) for n in splitter.get("pretokenizers", [])]
    modes = [(n.get("behavior"), n.get("invert"), n.get("add_prefix_space"), n.get("use_regex")) for n in splitter.get("pretokenizers", [])]
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"))
    return plain and steps == NORMALIZERS and parts == PRE_TOKENIZERS and modes == [("Removed", True, None, None), (None, None, False, False)]


def whole_tokens(tokenizer_json: str) -> dict[str, int]:
    """The offline proof: strings that are one pre-token and that encode alone as one token, with that token's id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not covered(tokenizer_json):
        return {}
    tok, stand_in, suffix = Tokenizer.from_str(tokenizer_json), byte_alphabet(), "</w>"
    candidates = {}
    for piece, ident in tok.get_vocab(with_added_tokens=False).items():
        if piece.endswith(suffix) and all(c in stand_in for c in piece[: -len(suffix)]):
            raw = bytes(stand_in[c] for c in piece[: -len(suffix)])
            try:
                string = raw.decode()
            except UnicodeDecodeError:
                continue
            if string and not _OTHER.search(string) and _PRE_TOKENS.findall(string) == [string]:
                candidates[string] = ident
    strings = list(candidates)
    encoded = tok.encode_batch_fast(strings, add_special_tokens=False)
    return {s: candidates[s] for s, e in zip(strings, encoded) if list(e.ids) == [candidates[s]]}


def remember(memo: dict, made: dict, entries: int) -> None:
    if len(memo) + len(made) <= entries and max(map(len, made)) <= MEMO_CHARS:
        memo.update(made)
    else:
        memo.update((k, v) for k, v in made.items() if len(k) <= MEMO_CHARS and len(memo) < entries)


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Coder:
    """Encodes texts in a worker. `pack` gives the little-endian unsigned 32-bit ids, `count` their number."""

    def __init__(self, tokenizer_json: str, whole: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tok = Tokenizer.from_str(tokenizer_json)
        # the same merges for what is normalised and split already
        self._merges = Tokenizer(self._tok.model)
        self._merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._tok.no_truncation()
        self._tok.no_padding()
        self._covered = covered(tokenizer_json)
        specials = sorted((t.content for t in self._tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self._added = set(specials)
        self._marks = tuple({s[:2] for s in specials})
        vocabulary = self._tok.get_vocab(with_added_tokens=False)
        self._last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._last[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self._whole_ids = {s: i.to_bytes(4, "little") for s, i in whole.items()}
        self._whole_counts = dict.fromkeys(whole, 1)
        self._ids, self._counts = dict(self._whole_ids), dict(self._whole_counts)
        self._chunk_ids: dict[bytes, bytes] = {}
        self._chunk_counts: dict[bytes, int] = {}

    def _strings(self, text: str) -> list[str]:
        if not any(m in text for m in self._marks):
            return self._plain(text)
        found: list[str] = []
        for at, part in enumerate(self._specials.split(text)):
            found.extend([part] if at % 2 else self._plain(part))
        return found

    @staticmethod
    def _plain(text: str) -> list[str]:
        if text.isascii() or not _OTHER.search(text):
            return _PRE_TOKENS.findall(text.lower())
        found: list[str] = []
        for chunk in _CHUNKS.split(text):
            if _OTHER.search(chunk):
                found.append(chunk)
            else:
                found.extend(_PRE_TOKENS.findall(chunk.lower()))
        return found

    def _merge(self, strings: list[str], plain: bool = False) -> list[bytes]:
        """Packed ids of each string. Plain pre-tokens go through the merges alone, one space apart: the last token of each ends a word."""
        whole = [] if plain else [s for s in strings if not _PRE_TOKENS.fullmatch(s) or _OTHER.search(s) or s in self._added]
        made = {s: pack_ids(e.ids) for s, e in zip(whole, self._tok.encode_batch_fast(whole, add_special_tokens=False))}
        rest = [s for s in strings if s not in made] if made else strings
        if rest:
            ids = np.array(self._merges.encode_batch_fast([" ".join(rest)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self._last[ids]) + 1)).tolist()
            if len(ends) == len(rest) and ends[-1] == 4 * len(ids):
                packed = ids.tobytes()
                made.update(zip(rest, map(packed.__getitem__, map(slice, [0, *ends], ends))))
            else:  # not a vocabulary of word ends
                made.update((s, pack_ids(e.ids)) for s, e in zip(rest, self._tok.encode_batch_fast(rest, add_special_tokens=False)))
        return list(map(made.__getitem__, strings))

    def _looked_up(self, strings: list[str], memo: dict, whole: dict, value, plain: bool) -> list:
        values = list(map(memo.get, strings))
        gaps = [i for i, v in enumerate(values) if v is None]
        if gaps:
            missing = list({strings[i] for i in gaps})
            made = dict(zip(missing, map(value, self._merge(missing, plain))))
            if len(memo) + len(made) > MEMO_ENTRIES:
                memo.clear()
                memo.update(whole)
            remember(memo, made, MEMO_ENTRIES)
            for i in gaps:
                values[i] = made[strings[i]]
        return values

    def _by_chunk(self, text: str, memo: dict, one: dict, whole: dict, value, join) -> list:
        """The value of each stretch between ASCII white space, which no pre-token crosses; new ones are worked out together."""
        chunks = text.encode().split()
        values = list(map(memo.get, chunks))
        gaps = [i for i, v in enumerate(values) if v is None]
        if gaps:
            missing = list({chunks[i] for i in gaps})
            joined = b" ".join(missing).decode()
            if plain := (joined.isascii() or not _OTHER.search(joined)) and not any(m in joined for m in self._marks):
                strings = _SPACED.findall(joined.lower())
                ends = [i for i, s in enumerate(strings) if s == " "]
                found = self._looked_up(list(filter(" ".__ne__, strings)), one, whole, value, plain)
                # without the spaces, of which there is one before each end but the first
                ends = [*map(sub, ends, range(len(ends))), len(found)]
            else:
                parts = list(map(self._strings, map(bytes.decode, missing)))
                found = self._looked_up([s for p in parts for s in p], one, whole, value, plain)
                ends = list(accumulate(map(len, parts)))
            made = {c: found[a] if b - a == 1 else join(found[a:b]) for c, a, b in zip(missing, [0, *ends], ends)}
            if len(memo) + len(made) > CHUNK_ENTRIES:
                memo.clear()
            remember(memo, made, CHUNK_ENTRIES)
            for i in gaps:
                values[i] = made[chunks[i]]
        return values

    def count(self, text: str) -> int:
        if not self._covered:
            return len(self._tok.encode(text, add_special_tokens=False).ids)
        return sum(self._by_chunk(text, self._chunk_counts, self._counts, self._whole_counts, lambda packed: len(packed) // 4, sum))

    def pack(self, text: str) -> bytes:
        if not self._covered:
            return pack_ids(self._tok.encode(text, add_special_tokens=False).ids)
        return b"".join(self._by_chunk(text, self._chunk_ids, self._ids, self._whole_ids, bytes, b"".join))


_CODERS: dict[int, Coder] = {}


class SharedCoder:
    """Ships a tokenizer file once to each executor. Its whole tokens are proved in the workers, once in each, so that the driver loads no vocabulary."""

    def __init__(self, spark, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as f:  # a local library file of the driver, not an input
            self._held = spark.sparkContext.broadcast(f.read())

    def get(self) -> Coder:
        content = self._held.value
        key = hash(content)
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = Coder(content, whole_tokens(content))
        return _CODERS[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every text. One scan, no shuffle."""
    coder = SharedCoder(docs.sparkSession, tokenizer_path)
    rows = chosen(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("text"))
    schema = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_tokens")).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder.get()
        for batch in batches:
            n = [own.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.binary_length(batch.column(1)).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  makes pa.compute available to the closure

    return rows.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
