"""The ten operators against brute force, and on nulls, empty and long texts, ties, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillflow.llm import bpe, exact_dedup, fm_quality, mixing, quality_rules, queries, simhash_bk, style_tree, substring_dedup, token_store, toxicity
from quillflow.llm.components import connected_components
from quillflow.llm.scratch import fresh_path, prepare
from tests.conftest import normal

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {65 + k: 97 + k for k in range(26)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, words string, size int, fp string"
LONG = " ".join(f"w{k % 4000}" for k in range(30_000))


def made_rows():
    """Documents with nulls everywhere, copies, near copies, shared passages, ties and one long text."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = text(40), text(120)
    texts = [None, "", " \t\n", "one", "one two", LONG, base, base, base.upper(), base + " tail", passage, text(20) + " " + passage + " " + text(9), passage + " " + passage, text(60) + "\n" + text(3), "a\x1cb <|endoftext|> Σς İ x²"]
    texts += [text(rnd.randint(1, 90)) for _ in range(25)]
    rows = [(k * 3, t, "en", f"s{k % 4}" if k % 5 else None, None, "x", "y", 1, "z") for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, base, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_bpe_equals_the_library(docs, none, library):
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, queries.tokenizer_path()).collect()}
    want = set()
    for key, text in pairs(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == want
    assert bpe.round_trip_digests(none, queries.tokenizer_path()).count() == 0
    apart = bpe.decode_documents(bpe.encode_documents(docs, queries.tokenizer_path()), queries.tokenizer_path())
    together = bpe.round_trip(docs, queries.tokenizer_path())
    assert Counter(map(str, apart.collect())) == Counter(map(str, together.collect()))


@pytest.mark.parametrize("kind", [bpe.Codec, token_store.LibraryCodec])
def test_bpe_on_random_characters(library, kind):
    codec, rnd = kind(queries.tokenizer_path()), random.Random(2)
    alphabet = "".join(map(chr, range(1, 0x250))) + "ΑΣςſßİ日本語😀́   's 've 123" * 8
    for k in range(1500):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) + ("<|startoftext|>" if k % 9 == 0 else "")
        assert np.frombuffer(codec.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_cuts_are_certain():
    codec = bpe.Codec(queries.tokenizer_path())
    for token in codec.vocab:
        assert codec.cuts(token.removesuffix("</w>")) == [token.removesuffix("</w>") + "</w>"]


def test_dictionary_sample_is_one_piece_a_key(spark, monkeypatch):
    """A key that many rows share counts once, every row can be chosen, and a chosen key without text gives no piece."""
    hashes = {r.id: r.h for r in spark.range(1, 41).select("id", F.xxhash64("id").alias("h")).collect()}
    order = sorted(hashes, key=hashes.get)
    hot, empty, chosen = order[0], order[1], order[:10]
    rows = [(k, "" if k == empty else f"word{k} again") for k in order] + [(hot, f"more {n}") for n in range(50)]
    made = []
    monkeypatch.setattr(token_store, "TRAINING_DOCUMENTS", 10)
    monkeypatch.setattr("zstandard.train_dictionary", lambda size, samples: made.append(samples) or type("D", (), {"as_bytes": lambda self: b"d"})())
    path = queries.tokenizer_path()
    prepare(spark)
    for partitions in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        assert token_store.train_dictionary(df, path, 1) == b"d"
    codec, width = token_store.library_codec(path), token_store.id_width(path)
    mine = {token_store.serialized(codec, f"word{k} again", 1, width)[0] for k in chosen if k not in (hot, empty)}
    assert made[0] == made[1] and len(made[0]) == 9 and mine < {*made[0]}


def test_token_store(spark, docs, none, library):
    path = fresh_path(spark, "store-test")
    token_store.write_store(docs, path, queries.tokenizer_path())
    found = [tuple(r) for r in token_store.checksums(spark, path).orderBy("start").collect()]
    start, want = 0, []
    for key, text in sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == want
    (one,) = token_store.read_documents(spark, path, [9]).collect()
    assert one.ids == [*library.encode("one", add_special_tokens=False).ids, 1]
    empty = fresh_path(spark, "store-test")
    token_store.write_store(none, empty, queries.tokenizer_path())
    assert token_store.read_store(spark, empty).count() == 0


def measured(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len({k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(3)})


def test_quality_measures(spark, docs, none):
    more = docs.union(spark.createDataFrame([(900, "a b c a b c d a b c", "en", "s", 1, "", "", 1, ""), (901, "x y\nx y\n \nx y z", "en", "s", 1, "", "", 1, "")], SCHEMA))
    found = Counter(tuple(r) for r in quality_rules.measured(more).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert found == Counter((key, *measured(text)) for key, text in pairs(more))
    assert quality_rules.ledger(none).count() == 0


def test_quality_ablation_agrees_with_the_ledger(docs):
    entries = [r.fail_bits for r in quality_rules.ledger(docs).collect()]
    mask = quality_rules.mask(quality_rules.CURRENT)
    for r in quality_rules.ablation(quality_rules.ledger(docs)).collect():
        bit = 1 << [x.name for x in quality_rules.RULES].index(r.rule)
        assert (r.failed, r.rejected_alone, r.kept_without) == (sum(bool(e & bit) for e in entries), sum(e & mask == bit for e in entries), sum(not e & mask & ~bit for e in entries))


def test_quality_keeps_the_columns(docs):
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.rejected(docs).where("kept").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_sql(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    found = normal(df.collect(), df.columns)
    cursor = duck.execute(queries.SQL[name])
    assert found == normal(cursor.fetchall(), [c[0] for c in cursor.description])


def test_exact_dedup(docs, none):
    found = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in exact_dedup.dedup(*exact_dedup.older_half(docs)).collect())
    groups: dict = {}
    for key, text in pairs(docs):
        groups.setdefault((text or "").translate(LOWER), []).append(key)
    want = Counter()
    for text, keys in groups.items():
        winner = max((k for k in keys if k is not None), default=None)
        for k in keys:
            want[(k, winner, len(keys), k is not None and k == winner, hashlib.sha256(text.encode()).digest())] += 1
    assert found == want
    assert exact_dedup.dedup(*exact_dedup.older_half(none)).count() == 0


def test_perfect_hash_is_minimal():
    raw = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    built, slots = exact_dedup.PerfectHash.build(exact_dedup._words(raw), raw)
    assert sorted(slots.tolist()) == list(range(5000))
    again = exact_dedup.PerfectHash.load(*built.dump())
    assert (again.slots(exact_dedup._words(raw), raw) == slots).all()
    assert built.dump()[2] == []


def test_perfect_hash_members_are_byte_checked(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([(3, "A"), (4, "c"), (5, "c")], "doc_id long, text string")
    found = {r.doc_id: (r.keep_id, r.kept, r.member) for r in exact_dedup.dedup(old, new).collect()}
    assert found == {1: (3, False, False), 2: (2, True, False), 3: (3, True, True), 4: (5, False, False), 5: (5, True, False)}


@pytest.mark.parametrize("keep", ["exact", "near"])
def test_one_document_of_each_class_stays(docs, none, keep):
    """Also of rows that repeat, of classes without any key and of a key with several texts; the columns stay as they were."""
    spark = docs.sparkSession
    more = docs.union(spark.createDataFrame([(None, "only without key", "a", "b", 1, "", "", 1, ""), (None, "ONLY without key", "a", "c", 1, "", "", 1, ""), (6 * 3, None, "x", None, 2, "", "", 1, ""), (0, "", "y", None, 2, "", "", 1, "")], SCHEMA))
    kept = (exact_dedup.kept_documents if keep == "exact" else simhash_bk.representatives)(more)
    assert kept.columns == more.columns
    rows, given = kept.collect(), more.collect()
    assert set(map(tuple, rows)) <= set(map(tuple, given))
    if keep == "exact":
        group = {(r.text or "").translate(LOWER): (r.text or "").translate(LOWER) for r in given}
    else:
        prints = {(r.text or "").translate(LOWER): simhash(r.text) for r in given}
        fps = sorted(set(prints.values()))
        of = components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3])
        group = {t: of[f] for t, f in prints.items()}
    groups: dict = {}
    for r in given:
        groups.setdefault(group[(r.text or "").translate(LOWER)], set()).add(r.doc_id)
    assert sorted(group[(r.text or "").translate(LOWER)] for r in rows) == sorted(groups)
    for r in rows:
        keys = groups[group[(r.text or "").translate(LOWER)]] - {None}
        assert r.doc_id == ((max if keep == "exact" else min)(keys) if keys else None)
    assert (exact_dedup.kept_documents if keep == "exact" else simhash_bk.representatives)(none).count() == 0


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash_components(docs, none):
    rows = [(key, simhash(text)) for key, text in pairs(docs)]
    fps = sorted({f for _, f in rows})
    groups = components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3])
    first: dict = {}
    for key, f in rows:
        if key is not None:
            first[groups[f]] = min(first.get(groups[f], key), key)
    found = Counter((r.doc_id, r.fp, r.component_id) for r in simhash_bk.near_duplicates(docs).collect())
    assert found == Counter((key, simhash_bk._signed(f), first.get(groups[f])) for key, f in rows)
    assert simhash_bk.near_duplicates(none).count() == 0


@pytest.mark.parametrize("limit", [4096, 8])
def test_bk_shards_lose_no_link(spark, limit):
    """Balls of near fingerprints; the small limit deals shards anew."""
    rnd, fps = random.Random(3), set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(rnd.randint(0, 7)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(simhash_bk._signed(f),) for f in fps], "fp long")
    found = {r.node: r.label for r in connected_components(simhash_bk.links(df, limit)).collect()}
    same = lambda labels: {frozenset(k for k in labels if labels[k] == v) for v in set(labels.values())}
    assert same(found) == {frozenset(map(simhash_bk._signed, g)) for g in same(want) if len(g) > 1}


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.label for r in connected_components(df).collect()}
    assert {found[k] for k in range(61)} == {0} and found[101] == 100


def removed(rows):
    first: dict = {}
    for key, words in rows:
        if key is not None:
            for k in range(len(words) - 12):
                w = tuple(words[k : k + 13])
                first[w] = min(first.get(w, key), key)
    for key, words in rows:
        gone = {k + d for k in range(len(words) - 12) for d in range(13) if key is not None and first[tuple(words[k : k + 13])] < key}
        yield key, len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 4000])
def test_substring_dedup(docs, none, chunk_bytes):
    """One chunk, and many that have to ask each other."""
    found = Counter(tuple(r) for r in substring_dedup.digests(substring_dedup.repeats(docs, chunk_bytes=chunk_bytes)).collect())
    assert found == Counter(removed([(key, WORD.findall(text or "")) for key, text in pairs(docs)]))
    assert substring_dedup.repeats(none).count() == 0


def test_substring_chunks_ignore_the_order_of_rows(docs):
    """Stages see a chunk's rows in whatever order the blocks of a shuffle arrive."""
    import pyarrow as pa

    rows, rnd = pairs(docs), random.Random(8)

    def built():
        rnd.shuffle(rows)
        return substring_dedup.Chunk(pa.table([pa.array([k for k, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"]), 7, 13, 2)

    first = built()
    for _ in range(5):
        again = built()
        assert again.ids == first.ids and [t.as_py() for t in again.texts] == [t.as_py() for t in first.texts]
        assert (again.hashes == first.hashes).all() and (again.key == first.key).all() and (again.left == first.left).all()


def test_substring_dedup_on_several_executors(tmp_path):
    """Three executors, whose blocks arrive in any order, against one."""
    import json
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    program = """
import json, sys
from pyspark.sql import SparkSession
from quillflow.llm import queries
conf = {"spark.checkpoint.dir": sys.argv[2], "spark.sql.shuffle.partitions": "5", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": sys.argv[2] + "/w"}
spark = SparkSession.builder.master(sys.argv[1]).config(map=conf).getOrCreate()
from quillflow.llm import substring_dedup
docs = queries.documents(spark, sys.argv[3]).repartition(7)
found = substring_dedup.digests(substring_dedup.repeats(docs, chunk_bytes=40_000)).collect()
print(json.dumps(sorted(map(list, found))))
"""
    results = []
    for master in ("local[2]", "local-cluster[3,1,1024]"):
        done = subprocess.run([sys.executable, "-c", program, master, str(tmp_path), "/root/testdata/sf0.001"], capture_output=True, text=True, cwd=root, timeout=300, check=True)
        results.append(json.loads(done.stdout.strip().splitlines()[-1]))
    assert results[0] == results[1] and any(r[2] for r in results[0])


def test_substring_spans(spark):
    shared = " ".join(f"p{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"a {shared} b"), (2, f"c d {shared} e")], "doc_id long, text string")
    (row,) = substring_dedup.repeats(df).where("doc_id = 2").collect()
    assert (row.n_removed, [tuple(s) for s in row.spans], row.kept) == (20, [(2, 22)], "c d e")


def filled(sizes):
    """Targets by repeated sharing: the definition, step by step."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, left, out = {s: 1 + k % 3 for k, s in enumerate(names)}, float(sum(sizes.values())), {}
    while len(out) < len(names):
        open_ = [s for s in names if s not in out]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        left = sum(sizes.values()) - sum(out.values())
    return out


def test_mix(docs, none):
    first, again = (Counter(tuple(r) for r in mixing.mix(docs, block=16, shard_slots=64).collect()) for _ in range(2))
    assert first == again
    sizes: dict = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = filled(sizes)
    rows = mixing.Mix(docs, 16, 64).mixed_sizes().collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((key, len(WORD.findall(text or ""))) for key, text in pairs(docs))
    taken: dict = {}
    for r in rows:
        name = None if r.src == "n" else r.src[1:]
        assert r.source_size == sizes[name] and abs(r.target - want[name]) < 1e-6 * (1 + want[name]) and 0 <= r.taken <= 3 * r.size
        taken[name] = taken.get(name, 0) + r.taken
    for name, n in taken.items():
        assert abs(n - want[name]) <= 48 + 0.02 * want[name]
    assert mixing.mix(none).count() == 0


def spark_hash(*parts):
    """Spark's xxhash64 of several columns: each is hashed with the hash so far as its seed."""
    seed = 42
    for x in parts:
        raw = x.encode() if isinstance(x, str) else x.to_bytes(4 if isinstance(x, Narrow) else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return simhash_bk._signed(seed)


class Narrow(int):
    """An int column; Python's own integers stand for long ones."""


def swapped(x, n, *keys):
    """Swap-or-not, step by step."""
    for k in range(1, mixing.ROUNDS + 1):
        partner = (spark_hash(*keys, Narrow(k)) % n - x) % n
        if spark_hash(*keys, Narrow(k), max(x, partner), "swap") & 1:
            x = partner
    return x


def test_mix_by_hand(docs):
    """Slots, shards, permuted blocks and the words taken of each row, without Spark."""
    block, shard_slots = 16, 64
    mix = mixing.Mix(docs, block, shard_slots)
    sources = {r.src: r for r in mix.sources.collect()}
    slots = {s: round(r.slot_to) - round(r.slot_from) for s, r in sources.items()}
    shards = max(1, -(-sum(slots.values()) // shard_slots))
    drawn = {s: Counter(spark_hash(Narrow(mixing.SEED), s, j) % shards for j in range(n)) for s, n in slots.items()}
    assert Counter({(r.src, r.shard): r["count"] for r in mix.counts.collect()}) == Counter({(s, k): n for s, c in drawn.items() for k, n in c.items()})
    want = Counter()
    for s, counts in drawn.items():
        k = 0
        for shard in sorted(counts):
            for _ in range(counts[shard]):
                turn, at = divmod(k, sources[s].blocks)
                want[(s, shard, swapped(at, sources[s].blocks, Narrow(mixing.SEED), s, turn), turn)] += 1
                k += 1
    assert Counter(tuple(r) for r in mix.picks.select("src", "shard", "block", "turn").collect()) == want
    times, streams = Counter(), {}
    for (s, _, b, _), n in want.items():
        times[(s, b)] += n
    for r in sorted(mix.rows.collect(), key=lambda r: (r.src, r.bucket, r.number)):
        streams.setdefault(r.src, []).extend([(r.src, r.bucket, r.number)] * r.size)
    taken = Counter()
    for s, words in streams.items():
        for at, row in enumerate(words):
            taken[row] += times[(s, at // block)]
    keys = {(r.src, r.bucket, r.number): (r.doc_id, r.size) for r in mix.rows.collect()}
    assert Counter((r.doc_id, r.size, r.taken) for r in mix.mixed_sizes().collect()) == Counter((*v, taken[k]) for k, v in keys.items())


def test_shard_counts_spread_like_multinomial_draws(spark):
    """Squared deviations of the counts from their expectation, over its variance: 1 a cell, neither 0 (dealt in turn) nor more."""
    totals = spark.createDataFrame([("sa", 10_000, 40_000), ("sb", 900, 2_500), ("n", 50, 150)], "src string, blocks long, slots long")
    cells = {(r.src, r.shard): r["count"] for r in mixing.shard_counts(totals, 256).collect()}
    shards = -(-42_650 // 256)
    for src, n in (("sa", 40_000), ("sb", 2_500), ("n", 150)):
        found = [cells.get((src, k), 0) for k in range(shards)]
        assert sum(found) == n
        assert 0.7 < sum((x - n / shards) ** 2 for x in found) / (n * (1 - 1 / shards)) < 1.4


def test_mixed_documents_have_the_taken_words(docs):
    words = sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(docs, block=16).collect())
    assert words == sum(r.taken for r in mixing.mix(docs, block=16).collect())
    assert mixing.mixed_documents(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutations(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"), F.lit(3)).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def auc(labels, scores):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    p = labels.sum()
    return (order[labels == 1].sum() - p * (p + 1) / 2) / (p * (len(labels) - p))


def planted(spark, label, n=400):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(5))
    rows = []
    for k in range(n):
        words, bad = [word() + ("." if rnd.random() < 0.1 else "") for _ in range(80)], rnd.random() < 0.3
        for at in rnd.sample(range(80), 4) if bad else ():
            words[at] = {"quality": words[at] + "###$$$", "toxic": rnd.choice(["vileword", "vilest", "scoundrel"])}[label]
        rows.append((k, " ".join(words), int(bad) if label == "toxic" else int(not bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], f"doc_id long, {label} int")


def test_noisy_or_is_the_product():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 7, 300):
        logits = rnd.normal(-3, 2, n)
        product = 1.0
        for z in logits:
            product *= 1 - 1 / (1 + np.exp(-z))
        assert abs(toxicity.noisy_or(logits) - (1 - product)) < 1e-12


def test_slopes_of_the_documents_likelihood():
    """Against differences of the likelihood, written as the product it is."""

    def loss(logits, counts, labels):
        out, at = 0.0, 0
        for n, label in zip(counts, labels):
            clean = np.prod([1 - 1 / (1 + np.exp(-z)) for z in logits[at : at + n]])
            out -= np.log(1 - clean) if label else np.log(clean)
            at += n
        return out

    rnd = np.random.default_rng(6)
    counts, labels = np.array([1, 4, 2, 9]), np.array([1, 0, 0, 1])
    logits = rnd.normal(-1, 1, counts.sum())
    found = toxicity.document_slopes(logits, counts, labels)
    for k in range(len(logits)):
        step = np.zeros(len(logits))
        step[k] = 1e-5
        assert abs((loss(logits + step, counts, labels) - loss(logits - step, counts, labels)) / 2e-5 - found[k]) < 1e-6


def test_slopes_of_the_factorisation_machine():
    """One step of fit from known parameters moves against the differences of the logistic loss."""
    rnd = np.random.default_rng(2)
    machine = fm_quality.Machine(0.1, np.zeros(fm_quality.SIZE), np.zeros((fm_quality.SIZE, fm_quality.FACTORS)))
    index, values = np.array([3, 8, 21]), np.array([0.7, -1.2, 2.0])
    machine.linear[index], machine.factors[index] = rnd.normal(size=3), rnd.normal(size=(3, fm_quality.FACTORS))
    error = 1 / (1 + np.exp(-machine.logit(index, values))) - 1
    total = (machine.factors[index] * values[:, None]).sum(axis=0)
    for k in range(3):
        for f in range(fm_quality.FACTORS):
            want = error * values[k] * (total[f] - machine.factors[index[k], f] * values[k])
            losses = []
            for d in (1e-5, -1e-5):
                machine.factors[index[k], f] += d
                losses.append(np.log1p(np.exp(-machine.logit(index, values))))
                machine.factors[index[k], f] -= d
            assert abs((losses[0] - losses[1]) / 2e-5 - want) < 1e-6


def test_training_rows_are_bounded_in_rows_and_bytes(spark):
    """A key with many rows and a long text don't make the sample larger."""
    from quillflow.llm.labelled import training_rows

    rows = [(k, "word " * 20) for k in range(60)] + [(7, "word " * 20)] * 500 + [(61, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(62)], "doc_id long, quality int")
    found = training_rows(docs, labels, "quality", 3, 1, 50, 2000).collect()
    allowed = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert 0 < len(found) <= min(len(allowed), 20) and all(len(r.text) == 100 for r in found)


@pytest.mark.parametrize(("module", "label"), [(fm_quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, docs, none, module, label):
    texts, labels = planted(spark, label)
    model = module.train(texts, labels)
    found = module.score(texts, model).join(labels, "doc_id").where("held_out").collect()
    assert {r.held_out for r in found} == {True} and len(found) > 50
    assert auc(np.array([r[label] for r in found]), np.array([r.score for r in found])) > 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % module.MODULUS == module.HELD_OUT for r in found)
    odd = module.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert module.score(none, model).count() == 0
    silent = module.train(texts, labels.limit(0))
    assert module.score(texts, silent).count() == texts.count()


def test_toxic_sentences_are_found(spark):
    texts, labels = planted(spark, "toxic")
    row = toxicity.score(texts, toxicity.train(texts, labels)).join(labels, "doc_id").where("toxic = 1 AND predicted = 1").join(texts, "doc_id").first()
    words = row.text.split()
    assert any(w.startswith(("vile", "scoundrel")) for s in row.offending for w in words[s.start : s.stop])


def test_factorisation_machine_identity():
    random_, machine = np.random.default_rng(1), fm_quality.Machine(0.3, np.zeros(fm_quality.SIZE), np.zeros((fm_quality.SIZE, 3)))
    index, values = np.array([1, 5, 9]), np.array([0.5, 2.0, -1.0])
    machine.linear[index], machine.factors[index] = random_.normal(size=3), random_.normal(size=(3, 3))
    want = 0.3 + machine.linear[index] @ values + sum(machine.factors[index[a]] @ machine.factors[index[b]] * values[a] * values[b] for a in range(3) for b in range(a))
    assert abs(machine.logit(index, values) - want) < 1e-12


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-banner">We use cookies</div><div class="teaser">Same on all pages</div><article><h1>Head &amp; line</h1><p><b>Bold</b>text&nbsp;%d<br>next<p>Second
 line %d</p><div class="box">Share this everywhere</div><form><input>x</form></article><aside>Side</aside><section id="comments"><p>first!</p></section><script>var t="</p>"</script><footer>&copy; x</footer></body></html>"""


def test_extraction(spark):
    pages = [(k, "http://a.example/x", PAGE % (k, k * 7), "z") for k in range(12)]
    pages += [(50, None, None, "z"), (51, "http://b.example", "", "z"), (52, "x", "<p>un<closed &am", "z"), (53, "http://a.example/y", "<article>" + "<p>long</p>" * 5000, "z"), (54, None, PAGE % (1, 2), "z"), (55, None, PAGE % (1, 2), "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    found = {r.page_id: r.text for r in style_tree.extract(df).collect()}
    assert found[3] == "Head & line Boldtext 3 next Second line 21"
    assert (found[50], found[51], found[52], len(found[53].split())) == ("", "", "un", 5000)
    # two pages of no site: no shared tree, so what has no telling name stays
    assert found[54] == found[55] == "Same on all pages Head & line Boldtext 1 next Second line 2 Share this everywhere"
    assert all(r.n_chars == len(r.text) for r in style_tree.extract(df).collect())
    assert style_tree.extract(df.limit(0)).count() == 0
    repeated = style_tree.extract(df.union(df)).collect()
    assert Counter((r.page_id, r.text) for r in repeated) == Counter({x: 2 for x in found.items()})


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p></article>", "a x=2 b"),
        ("<article><svg><text>label</text></svg><object><p>shown instead</p></object><noscript><p>plain</p></noscript></article>", "label shown instead plain"),
        ("<article>t<textarea>typed</textarea><select><option>one</select></article>", "t"),
        ('<article><div class="advice">kept</div><div class="commentary">kept too</div></article>', "kept kept too"),
        ('<div data-class="ad" class=lead>lead</div><div class="ad-box">buy</div><p hidden>no</p><p aria-hidden="true">yes</p>', "lead yes"),
    ],
)
def test_rules_and_names(page, text):
    assert " ".join(style_tree.kept_blocks(page, None)) == text


def entropies(pages):
    """The statistics of each judged node from the definition: the merged tree, probabilities and logarithms."""
    from math import log

    shown: dict = {}
    for page in dict.fromkeys(pages):
        found = style_tree.blocks(page)
        same = style_tree.identity(found)
        for block, text in found:
            node = block
            while node is not None:
                if node.tellable:
                    texts, layouts = shown.setdefault(node.path, {}).setdefault(same, (set(), set()))
                    texts.add(text)
                    layouts.add(tuple(node.children))
                node = node.parent
    out = {}
    for path, by_page in shown.items():
        m = len(by_page)
        if m == 1:
            out[path] = (1, 1.0)
            continue
        times = Counter(t for texts, _ in by_page.values() for t in texts)
        words = [(len(t.split()), times[t]) for texts, _ in by_page.values() for t in texts]
        content = 1 - sum(w * log(d, m) for w, d in words) / sum(w for w, _ in words)
        layouts = Counter(x for _, xs in by_page.values() for x in xs)
        n = sum(layouts.values())
        presentation = min(1.0, -sum(c / n * log(c / n, m) for c in layouts.values()))
        out[path] = (m, 1 - (1 - max(0.0, content)) * (1 - presentation))
    return out


def test_importance_from_the_definition(spark, sf_dir):
    """Every node of every site, also those of the given pages, against entropies computed one by one."""
    given = [(r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    made = [("http://a.example/x", PAGE % (k, k * 7)) for k in range(12)] + [("http://b.example/x", "<div class=c>" + "<p>x</p>" * (k % 3) + f"<p>own {k}</p></div>") for k in range(5)]
    made += [made[0], ("http://c.example", "<p>one page</p>"), (None, "<p>no site</p>"), ("http://d.example", None), ("http://d.example", "")]
    df = spark.createDataFrame(given + made, "url string, html string")
    sites: dict = {}
    for url, page in given + made:
        if url and "://" in url:
            sites.setdefault(url.split("/")[2].lower(), []).append(page or "")
    want = {(site, style_tree._hash(path)): x for site, pages in sites.items() for path, x in entropies(pages).items()}
    found = {(r.host, r.node): (r.pages, r.statistic) for r in style_tree.importance(style_tree.node_features(df)).collect()}
    assert found.keys() == want.keys() and len(found) > 20
    for key, (m, x) in want.items():
        assert found[key][0] == m and abs(found[key][1] - x) < 1e-9


def test_statistics_remove_repeated_branches(spark):
    """A box without any telling name goes by its statistics; a named one with a text of its own on every page stays by them."""
    page = '<body><div class="zone">Stock text %d of four</div><div class="content">%s</div><div class="header"><h2>Own %d</h2>%s</div></body>'
    text = lambda k: "".join(f"<p>own words {k} {j} here</p>" for j in range(1 + k % 9))
    df = spark.createDataFrame([(k, "http://a.example/x", page % (k % 4, text(k), k, text(k + 1000))) for k in range(200)], "page_id long, url string, html string")
    for r in style_tree.extract(df).collect():
        assert "Stock" not in r.text and f"own words {r.page_id} 0 here" in r.text and f"Own {r.page_id}" in r.text
    counts = {r.path: r.blocks for r in style_tree.removals(df).collect()}
    assert counts["statistics"] == 200 and "names" not in counts


def test_copies_of_a_page_are_one_page(spark):
    """A third of a site's rows are one page with changing adverts: its text isn't taken for a repeated box."""
    rows = [(k, "http://a.example/x", f'<div class="zone">advert {k % 5}</div><div class="body"><p>the one page with a text that many copies share</p><p>second part of it</p></div>') for k in range(60)]
    rows += [(100 + k, "http://a.example/x", f'<div class="zone">advert {k % 5}</div><div class="body"><p>another page number {k} with text</p><p>more {k}</p></div>') for k in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in style_tree.extract(df).collect()}
    assert found[7] == "the one page with a text that many copies share second part of it" and found[103] == "another page number 3 with text more 3"


def test_dedup_keeps_one_document_without_id(spark):
    some, other = "one two three four five six seven eight nine ten", "a quite different text about rivers and old stone bridges"
    docs = spark.createDataFrame([(1, some), (2, some), (None, other), (None, other), (None, some)], "doc_id long, text string")
    for dedup in (exact_dedup.kept_documents, simhash_bk.representatives):
        texts = [r.text for r in dedup(docs).collect()]
        assert sorted(texts) == sorted([some, other])
