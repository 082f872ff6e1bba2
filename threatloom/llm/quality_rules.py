"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule says when a document fails. On a sample of about SAMPLE_ROWS documents its cost is measured per evaluation (REPEATS of
them a row in one job, less the time of a job that evaluates none), and its selectivity on the rows that get to it: those
that pass the base rules and the rules tried before it. The cascade tries rules by rejections per cost, so most bad documents never reach
the dear ones. The order changes the cost alone: a document is kept if no rule rejects it.

Defined results: a null text is an empty one, which has no words. Every row is judged by itself, repeated or without doc_id.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.expressions import compute_once
from threatloom.llm.common import documents

SAMPLE_ROWS = 2_000
#: Evaluations of a rule on each sample row, and measurements of which the least counts.
REPEATS, TRIALS = 16, 2
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = "A-Z"
_GRAM = 5


def _count(text: Column, signs: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{signs}]"))


def with_metrics(df: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of every row, without a shuffle."""
    docs = documents(df, *keep).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit(_SPACES)) != "")
    docs = compute_once(docs, words=words, lines=lines)
    # Each word is hashed once; a window is the hash of its words' hashes.
    docs = compute_once(
        docs, hashes=F.transform("words", lambda word: F.xxhash64(word)), word_chars=F.length(F.array_join("words", "")).cast("long")
    ).drop("words")
    count = F.size("hashes")
    follow = F.arrays_zip(*[F.slice("hashes", k + 1, F.greatest(count, F.lit(1))).alias(f"w{k}") for k in range(_GRAM)])
    gram = F.transform(F.slice(follow, F.lit(1), F.greatest(count - _GRAM + 1, F.lit(0))), lambda window: F.xxhash64(window))
    docs = compute_once(docs, grams=F.when(count >= _GRAM, gram).otherwise(F.array().cast("array<long>")))
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    docs = compute_once(docs, placed=F.when(again, placed).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    size = F.greatest(F.size("placed"), F.lit(1))
    before = F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice("placed", F.lit(1), size - 1))
    near = F.arrays_zip(F.col("placed").alias("own"), before.alias("before"), F.slice("placed", F.lit(2), size).alias("after"))
    twice = lambda t: F.coalesce(t["own"]["g"] == t["before"]["g"], F.lit(False)) | F.coalesce(t["own"]["g"] == t["after"]["g"], F.lit(False))
    held = F.sort_array(F.transform(F.filter(near, twice), lambda t: t["own"]["i"]))
    docs = compute_once(docs, starts=F.when(F.size("placed") > 0, held).otherwise(F.array().cast("array<int>")))
    # Words under windows that start at s and next at t: all five, or as many as lie before t.
    apart = F.zip_with("starts", F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))), lambda s, t: F.least(F.lit(_GRAM), F.coalesce(t - s, F.lit(_GRAM))))
    covered = F.aggregate(apart, F.lit(0).cast("long"), lambda total, more: total + more)
    return compute_once(
        docs, n_words=count.cast("long"), n_symbols=_count(text, _SYMBOLS).cast("long"), n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), n_repeat_words=covered,
    ).drop("grams", "placed", "starts", "lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> dict[str, Column]:
    """When a document fails; on the columns of with_metrics()."""
    text, chars = F.col("text"), F.col("word_chars")
    distinct = F.size(F.array_distinct("hashes"))
    return {
        "symbols": 100 * F.col("n_symbols") > 10 * chars,
        "capitals": 2 * _count(text, _UPPER) > chars,
        "marks": 100 * _count(text, "!?") > 10 * chars,
        "word_length": (chars > 25 * F.col("n_words")) | (chars < 2 * F.col("n_words")),
        "repeated_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "few_distinct_words": (F.col("n_words") >= 50) & (10 * distinct < F.col("n_words")),
    }


def _seconds(repeated: DataFrame, fails: Column) -> float:
    """Least time of a job that evaluates ``fails`` on every row."""
    least = math.inf
    for _ in range(TRIALS):
        started = time.perf_counter()
        repeated.agg(F.count(F.when(fails, 1))).collect()
        least = min(least, time.perf_counter() - started)
    return least


def costs(sample: DataFrame, rules: dict[str, Column]) -> dict[str, float]:
    """Seconds of a rule's evaluations, as powers of two, so that small differences between two measurements change nothing."""
    repeated = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    idle = _seconds(repeated, F.col("_time") < 0)
    return {name: 2.0 ** round(math.log2(max(1e-3, _seconds(repeated, fails) - idle))) for name, fails in rules.items()}


def by_rejections(verdicts: dict[tuple[bool, ...], int], cost: dict[str, float]) -> list[str]:
    """Names in the order of rejections per cost among the rows that the names before let through.

    ``verdicts`` counts rows by what each rule of ``cost`` says. Of equal rates the cheaper rule is first, then the lesser name.
    """
    names, order = list(cost), []
    while len(order) < len(names):
        rejected = {name: sum(n for row, n in verdicts.items() if row[i]) for i, name in enumerate(names) if name not in order}
        best = min(rejected, key=lambda name: (-rejected[name] / cost[name], cost[name], name))
        order.append(best)
        verdicts = {row: n for row, n in verdicts.items() if not row[names.index(best)]}
    return order


def ordered(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, the most rejections per cost first."""
    total = docs.count()
    sample = docs.sample(min(1.0, sample_rows / max(1, total)), seed=1)
    sample = with_metrics(sample).where(~base_failed()).persist()
    try:
        said = [F.coalesce(fails, F.lit(False)).alias(f"rule{i}") for i, fails in enumerate(rules.values())]
        counts = sample.select(*said).groupBy(*[f"rule{i}" for i in range(len(rules))]).count().collect()  # at most the sample's rows
        return by_rejections({tuple(row)[:-1]: row["count"] for row in counts}, costs(sample, rules))
    finally:
        sample.unpersist()


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The first rule that rejects, null if none does; rules after it are not evaluated."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(rules[name], F.lit(name)).otherwise(verdict)
    return verdict


def judge(df: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the metrics, base_failed, the rule that rejected it if any, and kept."""
    rules = rules if rules is not None else default_rules()
    order = ordered(df, rules, sample_rows)
    docs = with_metrics(df, *keep).withColumn("base_failed", base_failed())
    docs = docs.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(rules, order)))
    return docs.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("hashes", "n_lines")
