"""Byte-pair encoding by forced-boundary splitting, and decoding.

A merge can only produce a vocabulary token, so two neighbouring symbols whose byte pair occurs inside no
token are never joined: the place between them is a certain cut.  A pre-token is split at its certain cuts,
each fragment is merged by itself (fragments repeat far more often than whole words and are memoised), and
the ids are concatenated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Entries of each of a memo's two generations: bounds a worker's memory whatever the vocabulary of the corpus.
MEMO_ENTRIES = 120_000
#: Longer words are encoded without being remembered.
MEMO_CHARS = 64
#: str.split() also cuts at these four; the tokenizer's white space does not include them.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Words of these characters are in normal form, and Python's lower case and classes agree with the tokenizer's.
_LATIN = re.compile("[!-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]+").fullmatch
#: The symbols that stand for bytes: printable Latin-1 characters for themselves, the others from U+0100 on in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SYMBOLS = {b: 0x100 + k for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}
#: The pre-tokenizer patterns known here, and their equals for words that _LATIN matches.
_LATIN_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")}


class Memo(dict):
    """A bounded dictionary that computes what it lacks; when full, what was not used again is forgotten."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.older = compute, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder for a tokenizers file whose model is a BPE with end-of-word suffix over byte symbols.

    Normaliser, pre-tokenizer and added tokens are those of the file; the merges are applied here.
    """

    def __init__(self, path: str, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE model without byte fallback and continuing prefix is needed")
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = (m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.joined = self.inner_pairs()
        self.id_bytes = {token: np.int32(k).astype("<i4").tobytes() for token, k in self.vocab.items()}
        self.latin_pattern = self.known_pattern(spec)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens with own matching rules aren't supported")
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.normalize = self.library.normalizer.normalize_str if self.library.normalizer else str
        self.pretokenize = self.library.pre_tokenizer.pre_tokenize_str
        self.size = 1 + max([*self.vocab.values(), *self.added.values()])
        self.fragments = Memo(self.merge, entries // 2)
        self.words = Memo(self.encode_word, entries)

    @staticmethod
    def known_pattern(spec: dict) -> re.Pattern | None:
        """The split pattern for Latin words, where normaliser and pre-tokenizer are of the known form."""
        normalizer, splits = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = [x["type"] for x in normalizer.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        known = known and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["add_prefix_space"] and not splits[1].get("use_regex", True)
        return _LATIN_PATTERNS.get(splits[0]["pattern"].get("Regex")) if known else None

    def inner_pairs(self) -> frozenset[str]:
        """Neighbouring byte symbols that some token holds side by side; every other pair is a certain cut."""
        inside: set[str] = set()
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            inside.update(a + b for a, b in zip(body, body[1:]))
        return frozenset(inside)

    def cuts(self, piece: str) -> list[str]:
        """The fragments of a pre-token; the last one carries the end-of-word suffix."""
        joined, start, out = self.joined, 0, []
        for k, pair in enumerate(map(add, piece, piece[1:]), 1):
            if pair not in joined:
                out.append(piece[start:k])
                start = k
        out.append(piece[start:] + self.suffix)
        return out

    def merge(self, fragment: str) -> bytes:
        """Ids of a fragment: the adjacent pair of lowest rank is joined, leftmost first, until none is left."""
        final = bool(self.suffix) and fragment.endswith(self.suffix)
        parts = list(fragment[: -len(self.suffix)] if final else fragment)
        if final:
            parts[-1] += self.suffix
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        return b"".join([self.id_bytes[p] for p in parts])

    def encode_word(self, word: str) -> bytes:
        """Ids, as little-endian int32, of a text that holds no added token."""
        return b"".join([self.fragments[f] for piece in self.pieces(word) for f in self.cuts(piece)])

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens in byte symbols; Latin words need no library call, and plain ones no search."""
        if self.latin_pattern:
            if text.isascii():
                if text.isalpha():
                    return [text.lower()]
                if text[:-1].isalpha() and "!" <= text[-1] <= "~":
                    return [text[:-1].lower(), text[-1]]
            if _LATIN(text):
                found = [text.lower()] if text.isalpha() else self.latin_pattern.findall(text.lower())
                return [x if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_SYMBOLS) for x in found]
        return [x for x, _ in self.pretokenize(self.normalize(text))]

    def encode_plain(self, text: str) -> bytes:
        """White space never joins with its neighbours, so the words between it can be encoded alone."""
        if _NOT_SPACE.search(text):
            return self.encode_word(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self.encode_plain(text)
        parts = self.added_pattern.split(text)
        return b"".join(np.array([self.added[p]], "<i4").tobytes() if p in self.added else self.encode_plain(p) for p in parts)


class Decoder:
    """The tokens of a file by id; needs no merges and no memo."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("decoder"):
            raise ValueError("a file without decoder is needed: its tokens are joined by spaces")
        named = [*spec["model"]["vocab"].items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]
        self.tokens = [b""] * (1 + max(k for _, k in named))
        for token, k in named:
            self.tokens[k] = token.encode()

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens joined by one space, as the library does for a file without decoder; UTF-8."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    """One decoder per worker process and file."""
    return Decoder(path)


@lru_cache(maxsize=2)
def codec(path: str, entries: int = MEMO_ENTRIES) -> Codec:
    """One codec per worker process, file and memo size."""
    return Codec(path, entries)


def id_lists(encoded: list[bytes]) -> pa.Array:
    """An Arrow list<int32> array whose k-th list is encoded[k]."""
    ends = np.cumsum([0, *map(len, encoded)]) // 4
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(encoded))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def id_arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a list<int32> array, without copying; a null list is empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist()):
        yield values[a : b if ok else a]


def encode_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every whole text; nothing is added at either end.

    Null and empty texts give an empty list, repeated rows are encoded each, an empty table gives an empty
    one.  ``tokenizer_path`` is a parameter: the file has to be readable at that path on every executor.
    """
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    key_field = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(tokenizer_path).encode
        for batch in batches:
            ids = id_lists([encode(x) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return source.mapInArrow(run, f"{key_field.name} {key_field.dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the text that each id list decodes to, special tokens included.  A null list is empty."""
    source = encoded.select(F.col(key), F.col(ids).alias("ids"))
    key_field = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(tokenizer_path).decode
        for batch in batches:
            texts = [decode(x) for x in id_arrays(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary()).cast(pa.string())], [key, "ids", "decoded"])

    return source.mapInArrow(run, f"{key_field.name} {key_field.dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", entries: int = MEMO_ENTRIES) -> DataFrame:
    """(key, ids, decoded): encode_documents and decode_documents in one pass, so that ids visit one worker only.

    Short tasks can leave an executor more workers than cores, each with its memos, so these stay at the usual size.
    """
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    key_field = source.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = codec(tokenizer_path, entries).encode, decoder(tokenizer_path).decode
        for batch in batches:
            ids = id_lists([encode(x) for x in batch.column(1).to_pylist()])
            texts = pa.array([decode(x) for x in id_arrays(ids)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, texts], [key, "ids", "decoded"])

    return source.mapInArrow(run, f"{key_field.name} {key_field.dataType.simpleString()}, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, from round_trip."""
    return round_trip(docs, tokenizer_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
