"""Quality rules as a short-circuit cascade of SQL expressions.

Every rule is an expression over a text, its words and its counts that is true where the rule rejects. On a bounded
sample each rule's selectivity (share rejected) and cost are measured, the cost being the seconds that the rule adds to
a job that reads the same rows; the rules are then tried in falling order of rejection per cost, inside one CASE
expression, so that a text which one rule rejects costs nothing more. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._text import SPACE

#: Rows of the sample that the order is chosen on, and characters of a text that may be in it.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 50_000
#: Files, spread over all of a table, that the sample is drawn from.
SAMPLE_FILES = 32
#: Times that a job goes through the sample, so that what a rule costs stands out from what a job costs.
TIMES = 12


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def word_chars(w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column, n: int = 3) -> Column:
    """Words in n-word windows found twice or more: windows are sorted by a 64-bit hash, equal neighbours
    kept, and the words that these cover counted once."""

    def covered(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("at")), lambda a, s: F.struct((a["n"] + F.least(F.lit(n), s - a["at"])).alias("n"), s.alias("at")), lambda a: a["n"])

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    window = lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(n)]).alias("h"), i.alias("i"))
    at = F.sequence(F.lit(0), F.size(w) - n)
    some = let(F.array_sort(F.transform(at, window)), lambda s: covered(repeated(s)))
    return F.when(F.size(w) > n, some).otherwise(F.lit(0)).cast("long")


@dataclass
class Text:
    """What rules read: counts are columns where they are at hand, else expressions, computed where a rule asks."""

    t: Column
    w: Column
    symbols: Column | None = None
    chars: Column | None = None
    dup_lines: Column | None = None

    def n_words(self) -> Column:
        return F.size(self.w)

    def n_symbols(self) -> Column:
        return n_symbols(self.t) if self.symbols is None else self.symbols

    def word_chars(self) -> Column:
        return word_chars(self.w) if self.chars is None else self.chars

    def lines_that(self, pattern: str, share: int) -> Column:
        """Whether more than that share, in hundredths, of the lines with words match."""
        return let(lines(self.t), lambda x: F.size(F.filter(x, lambda y: y.rlike(pattern))) * 100 > F.size(x) * share)

    def n_dup_lines(self) -> Column:
        return n_dup_lines(self.t) if self.dup_lines is None else self.dup_lines

    def n_lines(self) -> Column:
        return F.size(lines(self.t))


#: name -> rejects. Thresholds are shares, in whole numbers.
RULES: dict[str, Callable[[Text], Column]] = {
    "few_words": lambda x: x.n_words() < 50,
    "repeated_words": lambda x: n_repeat_words(x.w) * 100 > x.n_words() * 50,
    "symbols": lambda x: x.n_symbols() * 10 > x.n_words(),
    "shouting": lambda x: F.regexp_count(x.t, F.lit(r"[!?]{2,}")) * 5 > x.n_words(),
    "duplicate_lines": lambda x: (x.n_dup_lines() > 0) & (x.n_dup_lines() * 2 > x.n_lines()),
    "word_length": lambda x: let(x.word_chars(), lambda n: (n < x.n_words() * 2) | (n > x.n_words() * 20)),
    "few_letters": lambda x: F.regexp_count(x.t, F.lit(r"\p{L}[^\x20\x09-\x0D]*")) * 10 < x.n_words() * 7,
    "broken_lines": lambda x: x.lines_that(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$", 30),
    "bullet_lines": lambda x: x.lines_that(r"^[\x20\x09-\x0D]*[-*•]", 90),
}
BASE = ("few_words", "repeated_words")


def _seconds(df: DataFrame, rejects: Column) -> tuple[float, int]:
    """(time, rows rejected) of a job, the better of two."""
    q, best, n = df.agg(F.count_if(rejects).alias("n")), float("inf"), 0
    for _ in range(2):
        began = time.perf_counter()
        n = q.collect()[0].n
        best = min(best, time.perf_counter() - began)
    return best, n


def sampled(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list:
    """At most ``rows`` texts of at most SAMPLE_CHARS characters, drawn alike from all rows of SAMPLE_FILES files that lie evenly among the
    table's files, or of the whole frame where it isn't a table's. A few times as many are drawn and shuffled, and the first are taken."""
    some, files = df, sorted(df.inputFiles())
    if len(files) > SAMPLE_FILES:
        try:
            picked = [files[len(files) * i // SAMPLE_FILES] for i in range(SAMPLE_FILES)]
            some = df.where(F.col("_metadata.file_path").isin(picked))
        except AnalysisException:
            pass  # a frame of several tables, or of none
    n = some.count() or (some := df).count()
    source = some.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.char_length("t") <= SAMPLE_CHARS)
    return source.sample(min(1.0, 4 * rows / max(1, n)), seed=11).orderBy(F.rand(11)).limit(rows).collect()


def order_rules(df: DataFrame, text: str = "text", names: tuple[str, ...] = tuple(RULES), rows: int = SAMPLE_ROWS) -> list[str]:
    """Names by measured rejection per cost, best first.

    The sample is at most ``rows`` rows from all over the table; longer texts than SAMPLE_CHARS aren't sampled. An empty table keeps
    the given order.
    """
    sample = sampled(df, text, rows)
    if not sample:
        return list(names)
    local = df.sparkSession.createDataFrame(sample, "t string").coalesce(1).withColumn("w", words(F.col("t")))
    local = local.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))
    x, found, idle = Text(F.col("t"), F.col("w")), [], _seconds(local, F.size("w") < 0)[0]
    for name in names:
        took, n = _seconds(local, RULES[name](x))
        cost = max(took - idle, idle * 0.01) / (TIMES * len(sample))
        found.append(((n / (TIMES * len(sample)) + 1e-4) / cost, name))
    return [name for _, name in sorted(found, key=lambda f: -f[0])]


def cascade(order: list[str], x: Text) -> Column:
    """True where no rule rejects; a rule is evaluated only where those before it did not reject."""
    out = F.lit(True)
    for name in reversed(order):
        out = F.when(RULES[name](x), F.lit(False)).otherwise(out)
    return out


def quality(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row: ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text counts as empty and fails for its few words. Rows are judged alone, and whole however long: nulls, ties
    and repeated rows change nothing, other columns are left out, an empty table gives an empty table.
    """
    order = order_rules(df, text, tuple(n for n in RULES if n not in BASE))
    t, w = F.col("__t"), F.col("__w")
    out = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    out = out.withColumn("__w", words(t))
    out = out.select(*keep, "__t", "__w", F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"))
    x = Text(t, w, F.col("n_symbols"), F.col("word_chars"), F.col("n_dup_lines"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, x)).alias("kept"))


def kept_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that all rules keep, with the columns of ``df``. A null text counts as empty and goes; rows are judged
    alone and whole, so ties, repeated rows and other columns change nothing; an empty table gives an empty table."""
    order = order_rules(df, text)
    t = F.coalesce(F.col(text), F.lit(""))
    return df.where(let(words(t), lambda w: cascade(order, Text(t, w))))
