"""Quality rules with risk-controlled thresholds.

Four measures of a text (symbols for each word, duplicate lines for each line, words in repeated windows for each word, characters for each
word) have a fixed grid of cutoffs, in thousandths; a text is rejected where a measure is above its cutoff.  The labelled documents of good quality that the base
rules keep are the holdout.  For a stratum, a measure and a cutoff, k of the holdout's n would be rejected.  The cutoff is safe if a false rejection rate
of RISK / 4 or more would give k or fewer with a probability of at most CONFIDENCE divided by the number of all tests (the exact binomial tail, which is
the Clopper-Pearson bound, with Bonferroni's correction).  Each stratum takes the least safe cutoff of each measure, or none.  Thus, except with
probability CONFIDENCE, every stratum loses less than RISK of its good documents to all four measures together.

All of it is DataFrame operations: words are hashed in arrays, repeated windows are found by sorting the array of a text's window hashes, and
nothing is exploded or shuffled but counts for each stratum and cutoff.

Cases: null and blank texts have no words and fail the base rules; a null stratum is one of its own; strata without labels, or with too few, have no cutoffs and keep what the
base rules keep; null labels are ignored; repeated rows are kept; further columns are ignored; empty tables give empty results.  Window equality is that of 64-bit hashes in one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.llm.runtime import IDS, durable

RISK = 0.05
CONFIDENCE = 0.05
#: Cutoffs in thousandths, for each measure (numerator, denominator).
GRID = {
    ("n_symbols", "n_words"): (20, 50, 100, 200, 500, 1000),
    ("n_dup_lines", "n_lines"): (50, 100, 200, 300, 500, 700),
    ("n_repeat_words", "n_words"): (50, 100, 150, 200, 250, 290),
    ("word_chars", "n_words"): (7000, 8000, 9000, 10000, 12000, 15000),
}
_WINDOW = 8
_BLANKS = "\t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def _joined(a: str, by: int) -> Column:
    return F.zip_with(a, F.slice(a, F.lit(by + 1), F.size(a)), lambda x, y: F.xxhash64(x, y))


def measured(docs: DataFrame) -> DataFrame:
    """docs (.., text) -> all but text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    kept = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("text", text).select(
        *kept,
        F.filter(F.split(F.translate("text", _BLANKS, " " * len(_BLANKS)), " "), lambda x: x != "").alias("words"),
        F.length(F.translate("text", " " + _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, " " + _BLANKS, "") != "").alias("lines"),
    )
    counts = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    rows = rows.select(*kept, "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda x: F.xxhash64(x)).alias("h1"))
    rows = rows.select(*kept, *counts, _joined("h1", 1).alias("h2"))
    rows = rows.select(*kept, *counts, _joined("h2", 2).alias("h4"))
    rows = rows.select(*kept, *counts, F.slice(_joined("h4", 4), F.lit(1), F.greatest(F.col("n_words") - (_WINDOW - 1), F.lit(0)).cast("int")).alias("h8"))
    places = F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    rows = rows.select(*kept, *counts, places.alias("at"))
    twice = F.filter("at", lambda x, i: F.coalesce((F.get("at", i - 1)["h"] == x["h"]) & (i > 0), F.lit(False)) | F.coalesce(F.get("at", i + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-_WINDOW).alias("last")), lambda done, p: F.struct((done["n"] + F.least(F.lit(_WINDOW), p - done["last"])).alias("n"), p.alias("last")), lambda done: done["n"])
    rows = rows.select(*kept, *counts, covered.cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _log_factorial(x: Column) -> Column:
    """Stirling's series at x + 8, less the factors in between; right to about 1e-12."""
    z = x + F.lit(8.0)
    series = (z + 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    for j in range(1, 9):
        series = series - F.log(x + F.lit(float(j)))
    return series


def binomial_tail(n: Column, k: Column, p: float, terms: int = 5000) -> Column:
    """The probability of k or fewer among n at rate p, for k < n * p.  Beyond so many terms the rest is replaced by a geometric series that is not less."""
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int"))
    done = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda d, i: F.struct((d["term"] * ratio(k - i)).alias("term"), (d["sum"] + d["term"]).alias("sum")))
    rest = F.when(k > terms, done["term"] / (1 - ratio(k - terms))).otherwise(0.0)
    return first * (done["sum"] + rest)


def safe_cutoffs(holdout: DataFrame, *, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """holdout: measured good documents with a stratum -> (stratum, and the cutoff of each measure, or null)."""
    rate, tests = risk / len(GRID), sum(map(len, GRID.values()))
    options = F.array(*(F.struct(F.lit(num).alias("measure"), F.lit(cut).alias("cutoff"), (1000 * F.col(num) > cut * F.col(den)).alias("rejected")) for (num, den), cuts in GRID.items() for cut in cuts))
    counts = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(o["rejected"]).alias(f"k{i}") for i, o in enumerate(options[j] for j in range(tests))))
    named = [(num, cut) for (num, _), cuts in GRID.items() for cut in cuts]
    rows = counts.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(num).alias("measure"), F.lit(cut).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (num, cut) in enumerate(named)))).alias("t")).select("stratum", "n", "t.*")
    level = confidence / (max(1, counts.count()) * tests)
    safe = rows.where((F.col("k") < F.col("n") * rate)).where(binomial_tail(F.col("n"), F.col("k"), rate) <= level)
    return safe.groupBy("stratum").agg(*(F.min(F.when(F.col("measure") == num, F.col("cutoff"))).alias(f"cut_{num}") for num, _ in GRID))


def risk_controlled(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """docs and labels (doc_id, quality) -> (doc_id, the measures, base_failed, kept, and the cutoffs of the document's stratum)."""
    rows = durable(measured(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"), F.col(text).alias("text"))))
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    cutoffs = safe_cutoffs(rows.where("NOT base_failed").join(good, "doc_id", "left_semi"), risk=risk, confidence=confidence)
    cutoffs = durable(cutoffs)  # a row for each stratum that has one: broadcast up to IDS of them
    out = rows.join(F.broadcast(cutoffs) if cutoffs.limit(IDS + 1).count() <= IDS else cutoffs, "stratum", "left")
    rejected = [F.coalesce(1000 * F.col(num) > F.col(f"cut_{num}") * F.col(den), F.lit(False)) for num, den in GRID]
    verdict = ~F.col("base_failed")
    for r in rejected:
        verdict = verdict & ~r
    return out.withColumn("kept", verdict).drop("stratum")


def op7_risk_controlled(spark, sf_dir):
    from veritome.llm.runtime import table

    out = risk_controlled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")
