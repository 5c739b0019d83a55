"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is an expression over one row; nothing is shuffled and no user function runs. Repeated
five-word windows are found inside the row: windows are hashed, and where a hash occurs twice each window
becomes one long, its hash above its position, a primitive sort brings equal windows together, and their
words are compared before they count.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import TOKEN

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20

#: Frequent function words of English, French, German and Spanish; a fixed value.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from at an a "
    "le la les de des et en un une du est que pour dans par qui sur au avec pas ce "
    "der die das und den von mit ist für auf dem nicht sich ein eine zu als auch "
    "el los las y se del por con para su es al lo como no"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if ``100 * part / whole`` is below ``least`` or above ``most``. A text in which the
    whole is below ``whole_least`` is not judged."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    whole_least: int = 1


#: The verdict of the method, beside the fixed base rules.
RULES = (
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("shouting", "n_shouted", "n_words", most=40),
    Rule("stop_words", "n_stop_words", "n_words", least=2, whole_least=50),
    Rule("same_lines", "n_dup_lines", "n_lines", most=50),
    Rule("open_lines", "n_open_lines", "n_lines", most=90, whole_least=10),
)


def _call(name: str, *args) -> Column:
    return F.call_function(name, *args)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``row``, the struct of all columns, and one whole number for each measure.

    A null text has no words. Lines are split at line feeds; one without a word is not a line.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    without_symbols = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), SYMBOLS, body)
    one = df.select(
        F.struct("*").alias("row"),
        F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)).alias("words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(body) - F.length(without_symbols)).cast("long").alias("n_symbols"),
    )
    two = one.withColumns({
        "n": F.size("words"),
        "bits": F.ceil(F.log2(F.size("words") + F.lit(2.0))).cast("int"),
    }).withColumn("hashes", F.when(F.col("n") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window: only the others are sorted
    three = two.withColumn("packed", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: _call("shiftleft", h, F.col("bits")) + i)),
    ).otherwise(F.array().cast("array<bigint>")))

    def position(value: Column) -> Column:
        return value.bitwiseAND(_call("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")

    def same(a: Column, b: Column) -> Column:
        return (_call("shiftright", a, F.col("bits")) == _call("shiftright", b, F.col("bits"))) & (
            F.slice("words", position(a) + 1, WINDOW) == F.slice("words", position(b) + 1, WINDOW)
        )

    repeated = F.filter("packed", lambda v, i: F.coalesce(
        same(v, F.get("packed", i + 1)), F.lit(False)) | F.coalesce(same(v, F.get("packed", i - 1)), F.lit(False)))
    four = three.withColumn("starts", F.sort_array(F.transform(repeated, position)))
    # a start covers its window or, if the next start is nearer, the words up to that
    covered = F.aggregate(
        F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x,
    )
    # always 0; as the optimizer moves no filter below it, a filter on the verdict does not repeat the measures
    zero = F.shiftright(F.monotonically_increasing_id(), 63)
    return four.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (covered + zero).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: ~x.rlike(r"""[.!?:;"')\]][\x20\x09-\x0D]*$"""))).cast("long").alias("n_open_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: w.rlike("^[A-Z][A-Z]"))).cast("long").alias("n_shouted"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules a text fails, in the order of the table."""
    def verdict(rule: Rule) -> Column:
        part, whole = F.col(rule.part) * 100, F.col(rule.whole)
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (part < whole * rule.least)
        if rule.most is not None:
            bad = bad | (part > whole * rule.most)
        return F.when((whole >= rule.whole_least) & bad, F.lit(rule.name))

    return F.concat_ws(",", *[verdict(r) for r in rules])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, failed_rules and kept.

    A null or empty text has no words and fails; repeated rows are judged one by one; an empty table gives
    an empty result; columns other than doc_id and text are left out, whatever their names. Stop words are
    those of four languages: for others give rules of your own.
    """
    facts = measured(docs.select("doc_id", "text")).withColumns({"base_failed": base_failed(), "failed_rules": compiled(rules)})
    return facts.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules",
    )
