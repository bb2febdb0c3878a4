"""Quality rules as a bitmask ledger.

`ledger` measures every document once and evaluates every rule once; what a rule found is one bit of `failures`. A policy
is a named version of which bits reject a document, so a new policy, or the question what a rule costs (`ablation`), reads
the ledger and never a text again.

Only built-in functions run here. Repeated windows are found by the 64-bit hashes of five consecutive words, in the row of
their document.

Defined cases: a null or blank text has no words and fails `few_words`; equal rows give equal rows; an empty table gives an
empty ledger; columns other than doc_id and text are passed on by `ledger` only when asked for. A text is looked at whole
by one task, however long it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, words

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document under a version of the policy."""

    version: str
    rules: tuple[str, ...]

    def mask(self, names: list[str]) -> int:
        return sum(1 << names.index(r) for r in self.rules)


def rules() -> list[Rule]:
    c, words_at_least = F.col, F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("few_words", c("n_words") < 10),
        Rule("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule("many_symbols", 10 * c("n_symbols") > 3 * words_at_least),
        Rule("repeated_lines", (c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        Rule("odd_word_length", (c("n_words") >= 10) & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")))),
        Rule("few_letters", (c("n_words") >= 10) & (10 * c("n_letters") < 5 * c("word_chars"))),
        Rule("many_words", c("n_words") > 1_000_000),
    ]


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("v1", ("few_words", "repeated_words", "many_symbols", "repeated_lines", "odd_word_length")),
        Policy("v2", ("few_words", "repeated_words", "many_symbols", "repeated_lines", "odd_word_length", "few_letters")),
    )
}


MEASURES = ("n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", "n_repeat_words")


def _beside(name: str) -> str:
    """The name of a kept column in the result: with an underscore behind it if the ledger has a column of that name."""
    return name + "_" if name.lower() in (*MEASURES, "failures", "policy", "kept") else name


def measured(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select(F.struct(*keep).alias("_kept"), text.alias("_text"), words(F.col("text")).alias("_words"))
    n = F.size("_words")
    w = F.col("_words")
    hashes = F.when(n >= 2 * 1 + WINDOW - 1, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    hashed = split.withColumn("_hashes", hashes).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # a column of its own for each step that the next one reads at more than one place: else it is computed there anew
    pairs = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    paired = hashed.withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs).otherwise(empty))
    return paired.select(
        *[F.col("_kept")[k].alias(_beside(k)) for k in keep],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("\\p{L}")).cast("long").alias("n_letters"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_pairs")).cast("long").alias("n_repeat_words"),
    )


def _covered(pairs: Column) -> Column:
    """Words in windows whose hash is there twice: of sorted (hash, place), keep neighbours with equal hashes, add up the cover."""
    n = F.size(pairs)
    twice = F.transform(
        pairs,
        lambda p, k: F.when(((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get(pairs, k + 1)["h"] == p["h"])), p["i"]),
    )
    places = F.array_sort(F.filter(twice, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda s, i: F.struct((s["n"] + (i + WINDOW - F.greatest(s["end"], i))).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"],
    )


def ledger(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements of every document and `failures`, with bit k set where rule k of `rules()` fails."""
    bits = [F.when(r.fails, F.lit(1 << k)).otherwise(0) for k, r in enumerate(rules())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(documents, keep).withColumn("failures", total.cast("long"))


def names() -> list[str]:
    return [r.name for r in rules()]


def verdict(policy: Policy) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask(names()))) == 0


def apply_policy(table: DataFrame, version: str = "v1") -> DataFrame:
    return table.withColumn("policy", F.lit(version)).withColumn("kept", verdict(POLICIES[version]))


def ablation(table: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it rejects."""
    policy, known = POLICIES[version], names()
    masked = F.col("failures").bitwiseAND(F.lit(policy.mask(known)))
    counts = [F.count_if(F.col("failures").bitwiseAND(F.lit(1 << known.index(r))) != 0).alias(f"f_{r}") for r in policy.rules]
    alone = [F.count_if(masked == (1 << known.index(r))).alias(f"o_{r}") for r in policy.rules]
    row = table.agg(F.count(F.lit(1)).alias("n"), *counts, *alone)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failing"), F.col(f"o_{r}").alias("only"), F.col("n").alias("documents")) for r in policy.rules])
    return row.select(F.inline(each))


SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, [words[i], words[i+1], words[i+2], words[i+3], words[i+4]] AS x
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n >= 2),
covered AS (
  SELECT doc_id, CAST(sum(least(5, nxt - i)) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 5) AS nxt FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR 10 * n_symbols > 3 * greatest(n_words, 1)
            OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR (n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))) AS kept
FROM m
"""
