"""Substring dedup with fixed-block anchors.

A window is WINDOW consecutive words.  It repeats if its sequence also starts in a document with a smaller
key; the words of repeating windows are removed.

Any window holds a whole block of the non-overlapping blocks of BLOCK = (WINDOW + 1) // 2 words that its first
document is cut into.  So the index has those blocks, and every rolling BLOCK-word window is a probe: a probe
that meets a block and is known from two documents is a hit.  Around hits, and nowhere else, windows are
compared over all documents; runs of repeating windows are the maximal repeats.

Two exchanges carry this without a row per word.  Documents are dealt to chunks of bounded size.  A chunk
sends each *distinct* hash once, so a passage that many documents share costs one entry a chunk and not one
a document; hashes are sorted, dealt by their leading bits to parts, and travel as packed differences.  A part
answers with one bit an entry.  The chunk then knows about itself, and the bits tell it about all others.

    documents -> chunk: block hashes -> part: hits -> chunk: windows around hits -> part: who was first -> chunk: result

Blocks are compared by 32 bits and more (a wrong hit only adds windows to compare), windows by 96 bits.
"""

from __future__ import annotations

import hashlib
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bpe import Memo

WINDOW = 13
#: Bytes of text of a chunk, about: what a task holds at once. Packed cells number (all bytes / CHUNK_BYTES) squared at most.
CHUNK_BYTES = 8 << 20

_word_hashes = Memo(xxhash.xxh64_intdigest)


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: leading zero bytes cost next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _pack_bits(flags: np.ndarray) -> bytes:
    return _pack(np.packbits(flags))


def _unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(_unpack(data, np.uint8), count=n).astype(bool)


def _deltas(ordered: np.ndarray) -> bytes:
    return _pack(np.diff(ordered, prepend=ordered.dtype.type(0)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _rolling(words: np.ndarray, at: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of the size words from each position on."""
    out, f = np.zeros(len(at), np.uint64), 1
    for k in range(size):
        out += words[at + k] * np.uint64(f)
        f = f * factor & 0xFFFFFFFFFFFFFFFF
    return _mix(out)


class Chunk:
    """The documents of a chunk as one array of word hashes.

    A chunk is built anew in each stage that needs it, from rows that arrive in any order: it sorts them, so
    that a position means the same word in all stages, on any executor and after any retry.  Rows that agree in
    key and text are interchangeable.
    """

    def __init__(self, table: pa.Table, block: int, window: int, parts_log2: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.block, self.window, self.parts_log2 = block, window, parts_log2
        self.ids, self.texts = table.column("doc_id").to_pylist(), table.column("text")
        hashes, sizes = [], []
        for text in self.texts:
            words = self.words(text)
            hashes.append(np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words)))
            sizes.append(len(words))
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        known = np.array([i is not None for i in self.ids], bool)
        keys = np.array([0 if i is None else i for i in self.ids], np.int64)
        n = len(self.hashes)
        self.key = np.repeat(keys, self.sizes)
        self.place = np.arange(n) - np.repeat(self.starts, self.sizes)
        left = np.repeat(self.sizes, self.sizes) - self.place
        self.left = np.where(np.repeat(known, self.sizes), left, 0)  # documents without key take no part

    @staticmethod
    def words(text: pa.Scalar) -> list[bytes]:
        return text.as_buffer().to_pybytes().split() if text.is_valid else []

    def blocks(self):
        """Of the rolling block windows: positions, their order by truncated hash, the distinct hashes and where each starts."""
        at = np.flatnonzero(self.left >= self.block)
        h = _rolling(self.hashes, at, self.block, 0x9E3779B97F4A7C15) >> np.uint64(32 - self.parts_log2)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        return at, order, h[first], first

    def windows(self, at: np.ndarray):
        """Of the windows at some positions: order, distinct (hash, second hash), where each starts and its smallest key."""
        h = _rolling(self.hashes, at, self.window, 0xD6E8FEB86659FD93)
        g = (_rolling(_mix(self.hashes[: int(at[-1]) + self.window]) if len(at) else self.hashes, at, self.window, 0xA0761D6478BD642F) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, np.int64)
        smallest = np.minimum.reduceat(self.key[at][order], first) if len(first) else np.zeros(0, np.int64)
        return order, h[first], g[first], first, smallest

    def by_part(self, hashes: np.ndarray, bits: int):
        """(part, slice) of sorted hashes of so many bits."""
        part = (hashes >> np.uint64(bits - self.parts_log2)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        return [(int(part[a]), slice(a, b)) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)])]

    def answered(self, hashes: np.ndarray, bits: int, answers: dict[int, bytes]) -> np.ndarray:
        """The bit of each distinct hash from the parts' answers; a part that says nothing has none set."""
        out = np.zeros(len(hashes), bool)
        for part, where in self.by_part(hashes, bits):
            if part in answers:
                out[where] = _unpack_bits(answers[part], where.stop - where.start)
        return out


def _spread(flags: np.ndarray, first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A flag of each distinct hash to all its occurrences, in their first order."""
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(flags, np.diff(np.r_[first, len(order)]))
    return out


CELL = "part int, chunk int, kind int, n int, body binary, more binary, keys binary"
_CELL_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("body", pa.binary()), ("more", pa.binary()), ("keys", pa.binary())])
#: Kinds of rows: what parts and chunks tell each other, and what a chunk keeps for itself on the way.
ENTRIES, KEPT = 0, 1


def _cells(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _CELL_ARROW)], schema=_CELL_ARROW)


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {r["part"]: r["body"] for r in table.to_pylist() if r["kind"] == kind}


def repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every document.

    spans are the removed runs of words as (start, stop), kept the other words joined by one space.  A null
    text has no words.  A document without key loses nothing and takes nothing from others; documents with
    equal keys take nothing from each other, and neither do repeats inside one document.
    """
    block = (window + 1) // 2
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, ceil(size / chunk_bytes))
    b = min(24, ceil(log2(chunks)))
    dealt = source.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text")

    def send_blocks(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, block, window, b)
        at, order, distinct, first = chunk.blocks()
        if not len(first):
            return _cells([])
        aligned = np.logical_or.reduceat((chunk.place[at] % block == 0)[order], first)
        keys = chunk.key[at][order]
        several = np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)
        me = table.column("chunk")[0].as_py()
        return _cells([(p, me, ENTRIES, w.stop - w.start, _deltas((distinct[w] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), _pack_bits(aligned[w]), _pack_bits(several[w])) for p, w in chunk.by_part(distinct, 32 + b)])

    def find_hits(table: pa.Table) -> pa.Table:
        cells = table.to_pylist()
        hashes = np.concatenate([np.cumsum(_unpack(c["body"], np.uint32), dtype=np.uint32) for c in cells])
        aligned = np.concatenate([_unpack_bits(c["more"], c["n"]) for c in cells])
        several = np.concatenate([_unpack_bits(c["keys"], c["n"]) for c in cells])
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        many = (np.diff(np.r_[first, len(order)]) > 1) | np.logical_or.reduceat(several[order], first)
        hit = _spread(many & np.logical_or.reduceat(aligned[order], first), first, order)
        return _cells(_split_answers(cells, hit))

    def send_windows(docs_table: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs_table.num_rows or not hits.num_rows:
            return _cells([])
        chunk = Chunk(docs_table, block, window, b)
        at, order, distinct, first = chunk.blocks()
        hit = np.zeros(len(chunk.hashes) + window, np.int32)
        hit[at] = _spread(chunk.answered(distinct, 32 + b, _answers(hits, ENTRIES)), first, order)
        before = np.r_[0, np.cumsum(hit)]
        here = np.flatnonzero(chunk.left >= window)
        here = here[before[here + window - block + 1] > before[here]]
        if not len(here):
            return _cells([])
        chosen = np.zeros(len(chunk.hashes), bool)
        chosen[here] = True
        _, h, g, first, smallest = chunk.windows(here)
        me = docs_table.column("chunk")[0].as_py()
        rows = [(p, me, ENTRIES, w.stop - w.start, _deltas(h[w]), _pack(g[w]), _pack(smallest[w])) for p, w in chunk.by_part(h, 64)]
        return _cells([*rows, (me % (1 << b), me, KEPT, len(chosen), _pack_bits(chosen), None, None)])

    def find_first(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        cells, out = [c for c in rows if c["kind"] == ENTRIES], [tuple(c[f.name] for f in _CELL_ARROW) for c in rows if c["kind"] == KEPT]
        if cells:
            h = np.concatenate([np.cumsum(_unpack(c["body"], np.uint64), dtype=np.uint64) for c in cells])
            g = np.concatenate([_unpack(c["more"], np.uint32) for c in cells])
            keys = np.concatenate([_unpack(c["keys"], np.int64) for c in cells])
            order = np.lexsort((g, h))
            first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
            smallest = np.minimum.reduceat(keys[order], first)
            foreign = np.zeros(len(order), bool)
            foreign[order] = keys[order] > np.repeat(smallest, np.diff(np.r_[first, len(order)]))
            out += _split_answers(cells, foreign)
        return _cells(out)

    def remove(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_table.num_rows:
            return pa.table([[], [], [], pa.array([], _SPANS), pa.array([], pa.string())], schema=_RESULT)
        chunk = Chunk(docs_table, block, window, b)
        gone = np.zeros(len(chunk.hashes) + 1, np.int32)
        own = [r for r in answers.to_pylist() if r["kind"] == KEPT]
        if own:
            at = np.flatnonzero(_unpack_bits(own[0]["body"], own[0]["n"]))
            order, h, _, first, smallest = chunk.windows(at)
            foreign = _spread(chunk.answered(h, 64, _answers(answers, ENTRIES)), first, order)
            earlier = np.zeros(len(at), bool)
            earlier[order] = chunk.key[at][order] > np.repeat(smallest, np.diff(np.r_[first, len(order)]))
            starts = at[foreign | earlier]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed, spans, kept = [], [], []
        for k, (a, n) in enumerate(zip(chunk.starts.tolist(), chunk.sizes.tolist())):
            mine, words = gone[a : a + n], chunk.words(chunk.texts[k])
            count = int(mine.sum())
            removed.append(count)
            edges = np.flatnonzero(np.diff(np.r_[0, mine, 0])).tolist() if count else []
            spans.append([{"start": x, "stop": y} for x, y in zip(edges[::2], edges[1::2])])
            if count:
                words = [w for w, m in zip(words, mine.tolist()) if not m]
            kept.append(b" ".join(words))
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.sizes), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary()).cast(pa.string())], schema=_RESULT)

    hits = dealt.groupBy("chunk").applyInArrow(send_blocks, CELL).groupBy("part").applyInArrow(find_hits, CELL)
    first = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, CELL).groupBy("part").applyInArrow(find_first, CELL)
    return dealt.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, spans array<struct<start: int, stop: int>>, kept string")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS), ("kept", pa.string())])


def _split_answers(cells: list[dict], flags: np.ndarray) -> list[tuple]:
    """A part's answer to each chunk that has some bit set."""
    out, a = [], 0
    for c in cells:
        bits = flags[a : a + c["n"]]
        a += c["n"]
        if bits.any():
            out.append((c["part"], c["chunk"], ENTRIES, c["n"], _pack_bits(bits), None, None))
    return out


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM p WHERE i + 12 <= len(ws) AND doc_id IS NOT NULL),
m AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM g) WHERE f < doc_id),
x AS (SELECT DISTINCT rid, i + k AS i FROM m, (SELECT unnest(range(0, 13)) AS k)),
k AS (SELECT p.rid, count(*) AS n, string_agg(p.ws[p.i], ' ' ORDER BY p.i) AS t FROM p ANTI JOIN x ON p.rid = x.rid AND p.i = x.i GROUP BY p.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid)
"""
