"""Quality rules with adaptive thresholds. Native functions only.

Fixed rules judge a text by itself. The method adds thresholds that follow the data: quantile sketches of each measure, for each language
and source, merge from all tasks; a document is dropped if a measure lies many deviations from its group's median, as the group's own
quartiles and the document's size give them. Sketches have a fixed size, so a source that holds a third of all rows shuffles no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ward_analytics.llm.tables import cut

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 8
#: Fixed rules.
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Counted measures by what they are counted in, and how much of it is one occurrence: one symbol, one line, one window of words.
COUNTED = {"n_symbols": ("n_words", 1), "n_dup_lines": ("_n_lines", 1), "n_repeat_words": ("n_words", WINDOW)}
#: Measured by its mean, with a lower tail too.
MEAN = "chars_a_word"
#: How many standard deviations are far.
FAR = 8.0
#: The quartiles of a normal distribution, in standard deviations from its median.
QUARTILE = 0.6745
#: A group's quantiles count as much as those of its language when it has so many documents; the language's and those of all likewise.
PRIOR = 10
SKETCH_K = 200
_SKETCHED = (*COUNTED, MEAN, "n_words")


def _words(text: Column) -> Column:
    """All words."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def _doubled(names: str, apart: int) -> Column:
    """Names of runs twice as long: of each run with the one that begins so many words later. Those at the end are of no use."""
    after = F.slice(names, F.lit(apart + 1), F.size(names))
    return F.zip_with(names, after, lambda a, b: F.xxhash64(a, b))


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """The columns of the table and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words. A null text has no words.

    Each step is a column of its own, since Spark computes an expression within lambdas as often as it is written.
    """
    frame = documents.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", _words(F.col("_text")))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    frame = frame.withColumn("_lines", lines).select(
        *documents.columns,
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.when(F.size("_words") >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).alias("_names"),
    )
    for apart in (1, 2, 4):
        frame = frame.withColumn("_names", _doubled("_names", apart))
    frame = frame.withColumn("_windows", F.slice("_names", F.lit(1), F.greatest(F.size("_names") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    numbered = F.when(repeats, F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    frame = frame.withColumn("_by_name", numbered)
    after = F.slice("_by_name", F.lit(2), F.size("_by_name"))
    frame = frame.withColumn("_beside", F.zip_with("_by_name", after, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))))
    frame = frame.withColumn("_places", F.array_sort(F.array_distinct(F.flatten(F.filter("_beside", lambda p: p.isNotNull())))))
    after = F.slice("_places", F.lit(2), F.size("_places"))
    steps = F.zip_with("_places", after, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda total, n: total + n)
    frame = frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return frame.drop("_names", "_windows", "_by_name", "_beside", "_places")


def _rates(frame: DataFrame) -> DataFrame:
    """The measures as sketches take them: counted ones per unit, the mean length of words, and the number of words."""
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    rates = {f"_r_{m}": F.col(m) / one(unit) for m, (unit, _) in COUNTED.items()}
    rates[f"_r_{MEAN}"] = F.col("word_chars") / one("n_words")
    rates["_r_n_words"] = F.col("n_words").cast("double")
    return frame.withColumns(rates)


def quantiles(measured: DataFrame) -> DataFrame:
    """A row for each language and source: of each measure ``low``, ``median`` and ``high``, its quartiles. A null is a language or source of its own.

    Sketches are built for the finest groups and merged for the coarser ones, so documents are read once. The quartiles of a group mix with those of
    its language, and the language's with those of all, by the number of documents, so no group's limits jump when it grows by one. Quartiles stay
    where they are while less than a quarter of a group is junk.
    """
    sketches = [F.kll_sketch_agg_double(f"_r_{m}", F.lit(SKETCH_K)).alias(m) for m in _SKETCHED]
    fine = cut(measured.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketches))
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in _SKETCHED]]

    def read(frame: DataFrame, *keys: str) -> DataFrame:
        at = lambda m, q: F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))
        found = [F.struct(*(at(m, q).alias(name) for name, q in (("low", 0.25), ("median", 0.5), ("high", 0.75)))).alias(m) for m in _SKETCHED]
        return frame.where("n > 0").select(*keys, "n", F.struct(*found).alias("q"))

    every = read(fine.agg(*merged)).first()  # one row: three numbers for each measure
    value = lambda m, i: F.lit(every.q[m][i] if every else None).cast("double")
    whole = F.struct(*(F.struct(*(value(m, i).alias(i) for i in ("low", "median", "high"))).alias(m) for m in _SKETCHED))

    def mixed(own: Column, n: Column, wider: Column) -> Column:
        share = n / (n + PRIOR)
        part = lambda m, i: share * own[m][i] + (1 - share) * wider[m][i]
        return F.struct(*(F.struct(*(part(m, i).alias(i) for i in ("low", "median", "high"))).alias(m) for m in _SKETCHED))

    languages = read(fine.groupBy("lang").agg(*merged), "lang")
    languages = languages.select(F.col("lang").alias("l"), mixed(F.col("q"), F.col("n"), whole).alias("wider"))
    joined = read(fine, "lang", "source").join(languages, F.col("lang").eqNullSafe(F.col("l")))
    return joined.select("lang", "source", mixed(F.col("q"), F.col("n"), F.col("wider")).alias("q"))


def verdicts() -> dict[str, Column]:
    """For each measure whether it is near enough to what its group shows: the limit of a count is what the group's median rate gives for a document of this
    size, and so many deviations: the group's own spread between documents, and the chance spread of a count, which of a rare event is one occurrence.
    The mean length of words has both tails; that of a text shorter than the group's median one spreads wider."""
    found = {}
    for m, (unit, one) in COUNTED.items():
        size, q = F.greatest(F.col(unit), F.lit(1)), F.col(f"q.{m}")
        spread = (q["high"] - q["median"]) / QUARTILE
        chance = one * F.sqrt(size * q["median"] / one + 1)
        found[m] = F.col(m) <= size * (q["median"] + FAR * spread) + FAR * chance
    q, n = F.col(f"q.{MEAN}"), F.greatest(F.col("n_words"), F.lit(1))
    wider = F.sqrt(F.greatest(F.col("q.n_words.median") / n, F.lit(1.0)))
    off = F.col(f"_r_{MEAN}") - q["median"]
    spread = F.when(off > 0, q["high"] - q["median"]).otherwise(q["median"] - q["low"]) / QUARTILE
    found[MEAN] = F.abs(off) <= FAR * (spread * wider + 1 / F.sqrt(n))
    return found


def judge(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """The columns ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and far.

    base_failed: fewer than 20 words, or more than 30 percent of them in repeated 8-word windows. kept: not base_failed, and no measure
    beyond the limits of its language and source; far names those that are. Rows are judged by themselves, so repeated rows get equal results; other columns don't
    matter, whatever their names; an empty table gives an empty table.
    """
    own = documents.select(F.struct(*keep).alias("_row"), F.col(text).alias("text"), F.col(language).alias("lang"), F.col(source).alias("source"))
    measured = cut(_rates(measure(own)).drop("text"))  # read twice
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    limits = quantiles(measured).select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "q")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    found = verdicts()
    near = F.lit(True)
    for m in found:
        near = near & found[m]
    far = F.filter(F.array(*(F.when(~found[m], m) for m in found)), lambda m: m.isNotNull())
    return joined.select(
        "_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"),
        F.array_join(far, ",").alias("far"),
    )
