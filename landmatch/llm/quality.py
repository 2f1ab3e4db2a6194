"""Quality rules: a threshold table compiled into one projection.

``measure`` adds the counts, ``judge`` adds ratios and the verdict. Both are plain column
expressions, so the whole operator is one projection over the scan: no shuffle, no Python.

Defined cases: a null or blank text has zero words, fails the base rule and is not kept; a ratio
with a zero denominator is 0; repeated rows are judged one by one; other columns pass through
unless they carry the name of an output column, in which case the output column replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be by this at from or an not which have "
    "der die und von zu das mit den ist des sich dem nicht ein eine auf "
    "le la les de des et un une que en du dans pour est au par sur qui "
    "el los las del y que se con por una para su lo como al no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``metric`` lies outside ``low`` .. ``high`` (None: open)."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text.

    Equal windows are found by sorting window hashes, so a text costs n log n; only texts with
    a repeat pay for the positions.
    """

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(h):
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            ranked,
            lambda r: F.filter(
                r,
                lambda x, k: F.get(r, k - 1).h.eqNullSafe(x.h) | F.get(r, k + 1).h.eqNullSafe(x.h),
            ),
        )
        at = F.array_sort(F.transform(twice, lambda x: x.i))
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, i: F.struct((s.n + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s.n,
        )

    def unless_distinct(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(words, windows), unless_distinct))


def measure(docs: DataFrame, text: str = "text", more: tuple[Column, ...] = ()) -> DataFrame:
    """docs with the columns of COUNTS, all long; ``more`` columns are made beside the counts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]

    counted = let(
        words_of(whole),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).alias("n_stop_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.select(
        *[c for c in docs.columns if c not in (*COUNTS, "_words", "_lines")],
        counted.alias("_words"),
        by_line.alias("_lines"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        *more,
    )
    return out.select(
        *[c for c in out.columns if c not in ("_words", "_lines")],
        *[F.col(f"_words.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")],
        *[F.col(f"_lines.{c}").cast("long").alias(c) for c in ("n_lines", "n_dup_lines")],
    )


def ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def metrics() -> dict[str, Column]:
    return {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    }


def judge(measured: DataFrame, rules=RULES, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """Adds base_failed, failed_rules (names, in the table's order) and kept."""
    known = metrics()

    def broken(rule: Rule) -> Column:
        value = known[rule.metric]
        low = F.lit(False) if rule.low is None else value < rule.low
        high = F.lit(False) if rule.high is None else value > rule.high
        return F.when(low | high, F.lit(rule.metric))

    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    failed = F.array_compact(F.array(*[broken(r) for r in rules]))
    return measured.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns.

    A row number stands beside the counts: Spark does not push a filter through such a projection, where it would
    compute every count anew for each of the rules that name it.
    """
    measured = measure(docs, text, (F.monotonically_increasing_id().alias("_row"),))
    return judge(measured).where(F.col("kept") & (F.col("_row") >= 0)).select(*docs.columns)
