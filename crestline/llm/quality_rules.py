"""Quality rules: a short-circuit cascade (DataFrame operations only).

A document is rejected as soon as one rule fails it, so the order of the rules
sets the cost and nothing else. estimate_rules() runs each rule by itself over a
small sample and measures what it costs a document and which share it rejects;
the cascade then asks the rules by falling rejection per cost. It is one CASE
expression, whose later branches are not evaluated for a row that an earlier one
has settled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, id_and_text, let, table

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def count_without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more.

    Windows are compared by hash. Those that occur once are found by a hash set;
    only texts with repeats sort (hash, position) pairs, mark equal neighbours and
    add up the words that the marked windows cover.
    """

    def covered(pairs: Column) -> Column:
        marked = F.filter(F.transform(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: F.when(
            F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, k - 1)["h"], F.lit(False))
            | F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, k + 1)["h"], F.lit(False)), F.get(pairs, k)["i"])), lambda i: i.isNotNull())
        return let(F.sort_array(marked), lambda at: F.aggregate(
            F.sequence(F.lit(1), F.size(at)), F.lit(0),
            lambda total, k: total + F.coalesce(F.least(F.lit(3), F.get(at, k) - F.get(at, k - 1)), F.lit(3))))

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))

    windows = let(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, of))


#: What rules may ask for, each from the text and its words.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: count_without(text, SPACES).cast("long"),
    "n_symbols": lambda text, words: (F.char_length(text) - count_without(text, SYMBOLS)).cast("long"),
    "n_lines": lambda text, words: F.size(filled_lines(text)).cast("long"),
    "n_dup_lines": lambda text, words: let(filled_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": lambda text, words: repeat_words(words).cast("long"),
    "n_letters": lambda text, words: F.char_length(F.regexp_replace(text, r"\P{L}+", "")).cast("long"),
    "n_upper": lambda text, words: F.char_length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
}
BASE_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over METRICS, true where a document is to be rejected."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[..., Column]


BASE_RULES = (
    Rule("few words", ("n_words",), lambda n: n < 50),
    Rule("repeated words", ("n_words", "n_repeat_words"), lambda n, r: r * 100 > n * 50),
)
OTHER_RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: s * 5 > n),
    Rule("word length", ("n_words", "word_chars"), lambda n, c: (c < n * 2) | (c > n * 20)),
    Rule("repeated lines", ("n_lines", "n_dup_lines"), lambda n, d: d * 2 > n),
    Rule("few letters", ("word_chars", "n_letters"), lambda c, x: x * 10 < c * 6),
    Rule("upper case", ("n_letters", "n_upper"), lambda n, u: u * 2 > n),
)
RULES = BASE_RULES + OTHER_RULES


def with_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))


def failure(rule: Rule, ready: tuple[str, ...] = ()) -> Column:
    """The rule's condition; metrics named in ready are columns, others are computed in place."""
    text, words = F.col("text"), F.col("words")
    return rule.fails(*(F.col(m) if m in ready else METRICS[m](text, words) for m in rule.needs))


def estimate_rules(docs: DataFrame, rules: tuple[Rule, ...], rows: int = 512, seed: int = 1) -> list[dict]:
    """Cost (seconds a document) and selectivity (share rejected) of each rule, on a sample of about rows documents.

    Returned in the order to ask them: rejection per cost, falling; equal ones in the
    given order. Without any sampled row the given order stands. The share to sample comes from a count, so
    about that many rows are shuffled however many partitions docs has; a limit would
    send up to rows documents from each of them to one task.
    """
    own = id_and_text(docs)
    share = min(1.0, rows / max(own.count(), 1))
    sample = with_words(own.sample(share, seed).repartition(1)).persist()
    try:
        n = sample.count()
        if not n:
            return [{"rule": r.name, "cost": 0.0, "rejects": 0.0} for r in rules]

        def run(c: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hits = sample.agg(F.sum(c.cast("int"))).first()[0]
            return time.perf_counter() - began, hits

        run(F.lit(False))
        idle = min(run(F.lit(False))[0] for _ in range(2))
        found = []
        for rule in rules:
            run(failure(rule))  # compiles
            seconds, hits = run(failure(rule))
            found.append({"rule": rule.name, "cost": max(seconds - idle, 1e-4) / n, "rejects": hits / n})
        return sorted(found, key=lambda x: -x["rejects"] / x["cost"])
    finally:
        sample.unpersist()


def cascade(rules: tuple[Rule, ...], order: list[str], ready: tuple[str, ...] = ()) -> Column:
    """True where no rule fails, asked in the given order and no further than the first failure."""
    by_name = {r.name: r for r in rules}
    kept, *rest = [by_name[name] for name in order] or [None]
    if kept is None:
        return F.lit(True)
    chain = F.when(failure(kept, ready), False)
    for rule in rest:
        chain = chain.when(failure(rule, ready), False)
    return chain.otherwise(True)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """(doc_id, text, kept) for each row, by the cascade.

    order defaults to what estimate_rules() finds. Null texts count as empty (no
    words, so "few words" rejects them); null or repeated ids make no difference,
    every row is judged alone. Very long texts are judged whole. Other columns are
    ignored. An empty table gives an empty table.
    """
    own = id_and_text(docs, id_col, text_col)
    if order is None:
        order = [x["rule"] for x in estimate_rules(own, rules)]
    return with_words(own).select("doc_id", "text", cascade(rules, order).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text no rule rejects."""
    if order is None:
        order = [x["rule"] for x in estimate_rules(id_and_text(docs, id_col, text_col), rules)]
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    judged = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    judged = judged.select("row", "text", words_of(F.col("text")).alias("words"))
    return judged.filter(cascade(rules, order)).select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = id_and_text(table(spark, sf_dir, "documents"))
    order = [x["rule"] for x in estimate_rules(own, OTHER_RULES)]
    text, words = F.col("text"), F.col("words")
    measured = with_words(own).select("doc_id", "text", "words", *[METRICS[m](text, words).alias(m) for m in BASE_METRICS])
    base = failure(BASE_RULES[0], BASE_METRICS) | failure(BASE_RULES[1], BASE_METRICS)
    judged = measured.withColumn("base_failed", base)
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(OTHER_RULES, order, BASE_METRICS))
    return judged.select("doc_id", *BASE_METRICS, "base_failed", kept.alias("kept"))


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM docs),
pos AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM pos) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols * 5 > n_words) AND NOT (word_chars < n_words * 2 OR word_chars > n_words * 20)
  AND NOT (n_dup_lines * 2 > n_lines) AND NOT (n_letters * 10 < word_chars * 6) AND NOT (n_upper * 2 > n_letters) AS kept
FROM b
"""
