"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.

Defined results: a null text has no words and fails the base rules; so does an empty one.  A null threshold bound
is open.  Ratios over nothing are zero.  Rows, repeated ones included, are judged one by one, and every column of the
input is kept; a measure replaces an input column of its own name.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAPS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: The part of a word up to its first letter, for counting; possessive and anchored, so linear in the text.
LETTER_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    sorted(
        set(
            "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more"
            " my no not of on one or our she so some than that the their them there they this to was we were what when which who will"
            " with would you your"
            " aber als am auch auf aus bei bis das dem den der des die durch ein eine einem einen einer er es für hat ich im in ist"
            " mit nach nicht noch nur oder sich sie sind über um und von vor war wie wir wird zu zum zur"
            " au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que"
            " qui sa se ses son sont sur un une vous"
            " al como con de del el en entre es esta este ha la las le lo los más me mi muy no o para pero por que se sin sobre su sus"
            " también un una y ya".split()
        )
    )
)
#: Characters that may follow a word of a text without being part of it.
TRAILING = ".,;:!?"


@dataclass(frozen=True)
class Rule:
    """Keeps a document whose ``measure`` lies within both bounds; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: A document is kept if it passes every rule.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("letter_word_ratio", 0.7, None),
    Rule("capital_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.05, None),
    Rule("duplicate_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def word_list(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{GAPS}+"), lambda w: w != "")


def _once(value: Column) -> Column:
    """``value``, computed where it stands: the optimizer neither repeats it in a lambda nor moves it into a filter.

    Expressions that name the task's partition count as not deterministic, and such columns are never inlined.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeat_words(df: DataFrame, window: int, key=F.xxhash64) -> DataFrame:
    """Adds n_repeat_words: words within ``window``-word stretches that occur twice or more.

    Stretches are sorted by a hash, so the cost is near to linear in the length of the text, and equal neighbours are
    compared word by word.  Should different stretches ever share a hash, that text's are sorted by their words instead.
    The starts of equal neighbours are sorted again and each start covers the words to the next.  Each array that a lambda
    reads by place is a column of its own, computed once per row (``_once``).
    """
    n = F.size("__words")
    stretch = lambda i: F.slice("__words", i + 1, F.lit(window))
    hashed = lambda i: F.struct(key(*[F.col("__words")[i + k] for k in range(window)]).alias("h"), i.alias("i"))
    worded = lambda i: F.struct(stretch(i).alias("h"), i.alias("i"))
    none = F.array().cast("array<int>")
    starts = F.sequence(F.lit(0), n - window)

    def twins(keys: str, same) -> Column:
        """Both starts of each two neighbours that are the same; null in the place of those that only share a key."""
        before, after = F.slice(keys, F.lit(1), F.size(keys) - 1), F.slice(keys, F.lit(2), F.size(keys) - 1)
        return F.flatten(F.zip_with(before, after, lambda a, b: F.when(a["h"] != b["h"], none).when(same(a["i"], b["i"]), F.array(a["i"], b["i"])).otherwise(F.array(F.lit(None).cast("int")))))

    df = df.withColumn("__keys", _once(F.when(n >= window, F.sort_array(F.transform(starts, hashed)))))
    df = df.withColumn("__twins", _once(F.when(F.size("__keys") > 1, twins("__keys", lambda a, b: stretch(a) == stretch(b))).otherwise(none))).drop("__keys")
    df = df.withColumn("__keys", _once(F.when(F.array_contains(F.transform("__twins", lambda i: i.isNull()), True), F.sort_array(F.transform(starts, worded)))))
    found = F.when(F.col("__keys").isNull(), F.col("__twins")).otherwise(twins("__keys", lambda a, b: F.lit(True)))
    df = df.withColumn("__starts", _once(F.sort_array(F.array_distinct(found)))).drop("__keys", "__twins")
    steps = F.zip_with(
        F.slice("__starts", F.lit(1), F.size("__starts") - 1),
        F.slice("__starts", F.lit(2), F.size("__starts") - 1),
        lambda a, b: F.least(b - a, F.lit(window)),
    )
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step) + window
    return df.withColumn("n_repeat_words", F.when(F.size("__starts") > 0, covered).otherwise(F.lit(0)).cast("long")).drop("__starts")


def measures(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with its counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) and ratios."""
    body = F.coalesce(F.col(text), F.lit(""))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    df = docs.withColumn("__words", _once(word_list(F.col(text))))
    df = df.withColumn("__lines", _once(F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))))
    df = _repeat_words(df, window)
    in_list = lambda w: F.rtrim(F.lower(w), F.lit(TRAILING)).isin(*STOP_WORDS)
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__capitals": F.length(F.regexp_replace(body, r"\P{Lu}", "")),
            "__letter_words": F.regexp_count(body, F.lit(LETTER_WORD)),
            "__stop_words": F.size(F.filter("__words", in_list)),
            "__bullets": F.size(F.filter("__lines", lambda line: line.rlike(rf"^{GAPS}*[-*•]{GAPS}"))),
            "__ellipses": F.size(F.filter("__lines", lambda line: line.rlike(rf"(\.\.\.|…){GAPS}*$"))),
        }
    )
    df = df.withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "letter_word_ratio": _ratio(F.col("__letter_words"), F.col("n_words")),
            "capital_ratio": _ratio(F.col("__capitals"), F.col("word_chars")),
            # One is added, so that a text of a few words needs none.
            "stop_word_ratio": _ratio(F.col("__stop_words") + 1, F.col("n_words")),
            "duplicate_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "bullet_line_ratio": _ratio(F.col("__bullets"), F.col("n_lines")),
            "ellipsis_line_ratio": _ratio(F.col("__ellipses"), F.col("n_lines")),
        }
    )
    ratios = ("mean_word_chars", "symbol_ratio", "letter_word_ratio", "capital_ratio", "stop_word_ratio", "duplicate_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")
    kept = [c for c in docs.columns if c not in counts + ratios]
    return df.select(*kept, *[_once(F.col(c)).alias(c) for c in ratios + counts])


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one Boolean expression."""
    passed = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            passed = passed & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            passed = passed & (F.col(rule.measure) <= rule.most)
    return passed


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its measures, base_failed (under 10 words, or over a fifth of them repeated) and kept."""
    df = measures(docs, text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
