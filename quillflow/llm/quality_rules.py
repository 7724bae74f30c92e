"""Quality rules as a bitmask ledger, with DataFrame functions only.

``ledger`` measures every document and evaluates every rule once; it stores the measurements and one failure
bit per rule.  A policy is a named, versioned mask of rules: applying it, comparing two of them or asking
what a rule alone costs are bit operations over the ledger, which never read a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows found at least twice.

    Windows are 64-bit hashes with their position; after one sort equal windows are neighbours.  The marked
    positions, sorted again, cover min(3, gap to the one before) new words each.
    """
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, k: F.struct(F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2)).alias("h"), k.alias("p")),
    )
    marked = let(
        F.sort_array(windows),
        lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
    )
    return let(
        F.sort_array(F.transform(marked, lambda x: x["p"])),
        lambda p: total(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), x - F.get(p, k - 1)), F.lit(3)))),
    )


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words), all long, and what to carry along."""
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), *(F.col(c).alias(f"_c_{c}") for c in carry))
    words = F.array_remove(F.split("_text", SPACE), "")
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), repeated_words(w).alias("r")))
    by_lines = let(
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE)),
        lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("d")),
    )
    carried = [f"_c_{c}" for c in carry]
    counted = source.select(
        key,
        *carried,
        by_words.alias("_w"),
        by_lines.alias("_l"),
        F.regexp_count("_text", F.lit(SYMBOLS)).alias("_s"),
        F.regexp_count("_text", F.lit("[A-Z]")).alias("_u"),
    )
    parts = {"n_words": "_w.n", "word_chars": "_w.c", "n_symbols": "_s", "n_upper": "_u", "n_lines": "_l.n", "n_dup_lines": "_l.d", "n_repeat_words": "_w.r"}
    return counted.select(key, *carried, *(F.col(v).cast("long").alias(k) for k, v in parts.items()))


@dataclass(frozen=True)
class Rule:
    """failed: from the measurements to a boolean that is never null."""

    name: str
    failed: Callable[[], Column]


#: The position of a rule is its bit: append only.
RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repetitive", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 5 * F.col("word_chars")),
    Rule("duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
    Rule("upper_case", lambda: 100 * F.col("n_upper") > 50 * F.col("word_chars")),
    Rule("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
)

#: (name, version) -> the rules that reject.
POLICIES = {
    ("base", 1): ("few_words", "repetitive"),
    ("web", 1): ("few_words", "repetitive", "symbols"),
    ("web", 2): tuple(r.name for r in RULES),
}
CURRENT = ("web", 2)


def mask(policy: tuple[str, int]) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The measurements of every document and fail_bits (long): bit k is set if RULES[k] fails.

    Null and empty texts have no word and fail ``few_words`` alone.  Repeated rows give repeated rows.
    """
    bits = [F.when(r.failed(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(RULES)]
    all_bits = bits[0]
    for bit in bits[1:]:
        all_bits = all_bits.bitwiseOR(bit)
    return measured(docs, key, text, carry).withColumn("fail_bits", all_bits)


def passes(policy: tuple[str, int]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(entries: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """One row per rule of the policy: documents it fails, those that only it rejects, and what is kept without it."""
    chosen = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    by_bits = entries.groupBy(chosen.alias("bits")).agg(F.count(F.lit(1)).alias("docs"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if mask(policy) >> k & 1))
    has, only = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return (
        by_bits.select("bits", "docs", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(has, F.col("docs")).otherwise(0)).alias("failed"),
            F.sum(F.when(only, F.col("docs")).otherwise(0)).alias("rejected_alone"),
            F.sum(F.when(only | (F.col("bits") == 0), F.col("docs")).otherwise(0)).alias("kept_without"),
        )
    )


def judged(entries: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """A ledger with base_failed and, under a policy, kept: bits are compared, no text is read."""
    return entries.withColumns({"base_failed": ~passes(("base", 1)), "kept": passes(("base", 1)) & passes(policy)})


def rejected(documents: DataFrame, policy: tuple[str, int] = CURRENT) -> DataFrame:
    """(doc_id, base_failed, kept) and the measurements of every document under a policy."""
    return judged(ledger(documents), policy)


def passing(docs: DataFrame, policy: tuple[str, int] = CURRENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with the columns they came with.

    Null and empty texts have too few words and go; a null key decides nothing; repeated rows all stay or all go;
    very long texts are measured whole; an empty table gives an empty one.
    """
    others = tuple(c for c in docs.columns if c != key)
    kept = ledger(docs, key, text, others).where(passes(("base", 1)) & passes(policy))
    return kept.select(*(F.col(c) if c == key else F.col(f"_c_{c}").alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 5 * word_chars)::BIGINT
        + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 16 * (100 * n_upper > 50 * word_chars)::BIGINT
        + 32 * (word_chars > 15 * n_words)::BIGINT + 64 * (word_chars < 2 * n_words)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

#: The ablation of the current policy, whose mask has every rule.
ABLATION_SQL = f"""
WITH f AS ({SQL}), r AS (SELECT * FROM (VALUES {", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(RULES))}) AS v(rule, b))
SELECT rule, count(*) FILTER (fail_bits & b <> 0) AS failed, count(*) FILTER (fail_bits = b) AS rejected_alone, count(*) FILTER (fail_bits = b OR fail_bits = 0) AS kept_without FROM f, r GROUP BY rule
"""
