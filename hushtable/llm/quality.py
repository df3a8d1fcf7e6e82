"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every metric is a Column over the text; ``bind`` gives an intermediate result a
name inside the expression, so that the words of a text are split once. Texts
that are null or empty have no words and fail the base rules. Repeated rows
are judged alike; an empty table gives an empty table; further columns pass
through ``judged`` and ``accepted`` untouched. A very long text is measured
whole, in arrays of its words and windows that its task alone holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh, table

SPACES = " \t\n\x0b\x0c\r"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = """
the of and to a in is it that for was with be by on as at this from are or an he she his her not which have has
der die das und ist in den von zu mit sich des auf für nicht ein eine dem im als auch es an er hat
le la les de des du et en un une que qui dans pour par sur est pas au avec il elle ce se plus
el los las del y que por con para su una al lo como más o pero sus se no un es
""".split()


@dataclass(frozen=True)
class Rule:
    """A metric must be ``low`` at least and ``high`` at most (None: no bound)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_words", 2, None),
    Rule("dup_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.5),
    Rule("exclaimed_word_share", None, 0.25),
    Rule("pipe_word_share", None, 0.2),
    Rule("letter_share", 0.6, None),
)


METRICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "stop_words", "dup_line_share",
    "bullet_line_share", "ellipsis_line_share", "exclaimed_word_share", "pipe_word_share", "letter_share",
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def covered(p: Column) -> Column:
    """How many words the 3-word windows at the sorted places cover: each adds what the next one does not."""
    return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)).cast("int"))), F.lit(0), lambda a, x: a + x)


def repeated_by_text(words: Column) -> Column:
    """``repeated_words`` by sorting the windows themselves."""
    keyed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: x["w"].eqNullSafe(F.get(s, k - 1)["w"]) | x["w"].eqNullSafe(F.get(s, k + 1)["w"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    return bind(F.sort_array(keyed), lambda s: bind(places(s), covered))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more.

    A window is packed into one integer, its hash above its place, because
    Spark sorts arrays of integers without boxes. Equal hashes are confirmed on
    the words; a text in which two different windows share a hash is judged by
    the windows themselves.
    """
    bits = F.length(F.bin(F.size(words).cast("long")))

    def by_hash(b: Column) -> Column:
        keyed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), b).bitwiseOR(i.cast("long")))

        def from_sorted(s: Column) -> Column:
            place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).cast("int")
            alike = lambda x, y: F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), b) == 0, F.lit(False))
            pairs = F.filter(s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1)))

            def confirmed(p: Column) -> Column:
                differ = lambda x, y: F.exists(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda o: F.get(words, place(x) + o) != F.get(words, place(y) + o))
                clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda k: alike(F.get(p, k), F.get(p, k - 1)) & differ(F.get(p, k), F.get(p, k - 1)))
                return F.when(F.size(p) == 0, F.lit(0)).when(clash, repeated_by_text(words)).otherwise(bind(F.sort_array(F.transform(p, place)), covered))

            return bind(pairs, confirmed)

        return bind(F.sort_array(keyed), from_sorted)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(bits, by_hash))


def measured(text: Column) -> Column:
    """A struct of all metrics of a text."""
    text = F.coalesce(text, F.lit(""))
    bare = F.trim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    count = lambda values, test: F.size(F.filter(values, test))

    def of_lines(w: Column, lines: Column) -> Column:
        n, n_lines = F.size(w), F.size(lines)
        word_chars = F.length(F.array_join(w, "")).cast("long")
        n_symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))
        n_dup = n_lines - F.size(F.array_distinct(lines))
        without = lambda part: F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
        stop = sorted(set(STOP_WORDS))
        return F.struct(
            n.cast("long").alias("n_words"), word_chars.alias("word_chars"), n_symbols.cast("long").alias("n_symbols"),
            n_dup.cast("long").alias("n_dup_lines"), repeated_words(w).cast("long").alias("n_repeat_words"),
            share(word_chars, n).alias("mean_word_chars"), share(n_symbols, n).alias("symbols_per_word"),
            F.size(F.array_distinct(F.filter(w, lambda x: x.isin(stop)))).alias("stop_words"),
            share(n_dup, n_lines).alias("dup_line_share"),
            share(count(lines, lambda x: F.ltrim(x).rlike("^[-*•] ")), n_lines).alias("bullet_line_share"),
            share(count(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")), n_lines).alias("ellipsis_line_share"),
            share(without("!!") / 2, n).alias("exclaimed_word_share"),
            share(without("|"), n).alias("pipe_word_share"),
            share(F.length(F.regexp_replace(text, "\\P{L}+", "")), word_chars).alias("letter_share"),
        )

    full_lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return bind(words, lambda w: bind(full_lines, lambda lines: of_lines(w, lines)))


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "quality") -> DataFrame:
    """The table with one struct more: the metrics, ``base_failed``, ``kept`` and ``failed`` (the metrics out of bounds)."""
    def verdict(m: Column) -> Column:
        base_failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        bad = []
        for rule in rules:
            tests = [t for t in (None if rule.low is None else m[rule.metric] < rule.low, None if rule.high is None else m[rule.metric] > rule.high) if t is not None]
            bad.append(F.when(reduce(lambda a, b: a | b, tests), F.lit(rule.metric)))
        failed = F.array_compact(F.array(*bad))
        return F.struct(*(m[c].alias(c) for c in METRICS), base_failed.alias("base_failed"), (~base_failed & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"))

    return df.withColumn(into, bind(measured(F.col(text)), verdict))  # bound, as a filter on it would repeat the expression


def accepted(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass all rules, with the columns of the table."""
    (into,) = fresh(df, "_quality")
    return judged(df, rules, text, into).where(F.col(into)["kept"]).select(*df.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(q[c].alias(c) for c in out))
