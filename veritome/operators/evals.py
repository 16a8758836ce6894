"""Metrics of retrieval, answers and abstention, threshold sweeps, and samples for evaluation sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.functions import text as X
from veritome.operators.answer import Run
from veritome.sources.tables import durable


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.coalesce(F.array_contains(F.slice(ranked, 1, k), gold), F.lit(False)).cast("int")


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    at = F.array_position(ranked, gold)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def ungrounded_rate(claims: DataFrame) -> DataFrame:
    """By query; null, not 0, where a query has no claim."""
    return claims.groupBy("query_id").agg(X.rounded(F.avg(F.when(F.col("supported").isNotNull(), (~F.col("supported")).cast("int"))), 4).alias("ungrounded_rate"))


def citation_accuracy(claims: DataFrame) -> DataFrame:
    """claims (query_id, citation, gold): the share of cited that is gold; null if none is cited."""
    cited = F.coalesce(F.col("citation"), F.lit("")) != ""
    return claims.groupBy("query_id").agg(F.round(F.avg(F.when(cited, (F.col("citation") == F.col("gold")).cast("int"))), 4).alias("citation_accuracy"))


def at_share(values: Column, share: float) -> Column:
    """The value at place floor(share * n) of the sorted ones, the last at most; 0 if there are none."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.sort_array(values), F.least(n, F.floor(n * share).cast("int") + 1))).otherwise(0.0)


def placed(df: DataFrame, value: str, keys: list[str], places: Callable[[Column], Column]) -> DataFrame:
    """(keys, mark, value): the values at given places of the sorted ones of each key; places makes an array of (mark, place), places from 1, of how many there are. Nulls don't count.

    Counts of the distinct values are sorted into ranges of equal sizes, which also cut a key that has most of them. The counts of the ranges tell in which one a place lies, and only those are looked
    through, each by itself: no task sees all values of a key.
    """
    key = F.struct(*keys).alias("_key")
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_value")).agg(F.count("*").alias("times"))
    ranged = durable(counts.repartitionByRange("_key", "_value").withColumn("_range", F.spark_partition_id()))
    earlier = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_key", "_range").agg(F.sum("times").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    wanted = places(F.sum("n").over(W.partitionBy("_key")))
    sizes = sizes.withColumn("wanted", wanted).withColumn("wanted", F.filter("wanted", lambda w: (w["place"] > F.col("before")) & (w["place"] <= F.col("before") + F.col("n"))))
    upto = F.col("before") + F.sum("times").over(W.partitionBy("_key", "_range").orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = ranged.join(sizes.where(F.size("wanted") > 0).drop("n"), ["_key", "_range"]).withColumn("upto", upto)
    here = F.filter("wanted", lambda w: (w["place"] <= F.col("upto")) & (w["place"] > F.col("upto") - F.col("times")))
    return rows.select("_key", "_value", F.explode(here).alias("at")).select(*(F.col("_key")[k].alias(k) for k in keys), F.col("at.mark").alias("mark"), F.col("_value").alias("value"))


def quantiles_by_rank(df: DataFrame, value: str, shares: list[float], keys: list[str]) -> DataFrame:
    """Like at_share, for any number of rows: (keys, share, value)."""
    marks = F.array(*map(F.lit, shares))
    found = placed(df, value, keys, lambda n: F.transform(marks, lambda s: F.struct(s.alias("mark"), F.least(n, F.floor(n * s) + 1).alias("place"))))
    return found.withColumnRenamed("mark", "share")


def aggregated(rows: DataFrame) -> DataFrame:
    """rows (answerable, abstained, recall_at_k, reciprocal_rank, ungrounded_rate, citation_accuracy, parse_failed[, latency]) -> one row of means, and the 95th percentile of latencies if there are any.

    Parse failures are a share of the answerable rows, which alone are parsed.
    """
    good, bad = F.col("answerable"), ~F.col("answerable")
    mean = lambda c, when: F.round(F.coalesce(F.avg(F.when(when, F.col(c).cast("double"))), F.lit(0.0)), 4)
    means = rows.agg(
        F.count_if(good).alias("n_answerable"), F.count_if(bad).alias("n_adversarial"), mean("recall_at_k", good).alias("recall_at_k"), mean("reciprocal_rank", good).alias("mrr"),
        mean("ungrounded_rate", good).alias("ungrounded_claim_rate"), mean("citation_accuracy", good).alias("citation_accuracy"), F.count_if(good & ~F.col("abstained")).alias("answers_produced"),
        mean("abstained", good).alias("false_refusal_rate"), mean("abstained", bad).alias("abstention_correctness"), F.round(F.coalesce(F.avg(F.when(bad, (~F.col("abstained")).cast("double"))), F.lit(0.0)), 4).alias("unsupported_answer_rate"),
        mean("parse_failed", good).alias("parse_failure_rate"),
    )
    if "latency" not in rows.columns:
        return means
    late = quantiles_by_rank(rows.withColumn("all", F.lit(1)), "latency", [0.95], ["all"]).agg(F.max("value").alias("p95"))
    return means.join(F.broadcast(late)).withColumn("p95_latency", F.round(F.coalesce("p95", F.lit(0.0)), 3)).drop("p95")


def evaluated(results: DataFrame, gold: DataFrame, k: int = 3, run: Run | None = None) -> DataFrame:
    """gated results and gold (query_id, gold), any number for each question -> the rows that aggregated() takes; a question without gold is adversarial.

    Of a run over these results come whether it abstained, the share of its claims that aren't supported, the share of cited clauses that are gold, and whether its reply was unreadable; without one,
    abstaining is the gate's, and the measures of claims are null.
    """
    ids = F.transform("chunks", lambda c: c["chunk_id"])
    rows = results.select("query_id", F.coalesce(ids, F.array().cast("array<string>")).alias("ranked"), (~F.col("answerable")).alias("abstained"))
    each = rows.join(gold, "query_id").groupBy("query_id").agg(F.max(recall_at(F.col("ranked"), F.col("gold"), k)).alias("recall_at_k"), F.max(reciprocal_rank(F.col("ranked"), F.col("gold"))).alias("reciprocal_rank"))
    none = F.lit(None).cast("double")
    found = rows.join(each, "query_id", "left")
    if run is None:
        found = found.withColumn("ungrounded_rate", none).withColumn("citation_accuracy", none).withColumn("parse_failed", F.lit(0))
    else:
        cited = run.answers.select("query_id", F.explode("cited_clauses").alias("citation")).join(gold.select("query_id", F.col("gold").alias("citation"), F.lit(1).alias("hit")).distinct(), ["query_id", "citation"], "left")
        accuracy = cited.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("citation_accuracy"))
        failed = run.replies.select("query_id", F.col("parse_failed").cast("int").alias("parse_failed"))
        found = found.drop("abstained").join(run.answers.select("query_id", "abstained"), "query_id", "left").join(ungrounded_rate(run.verdicts), "query_id", "left").join(accuracy, "query_id", "left").join(failed, "query_id", "left")
    return found.select("query_id", F.col("recall_at_k").isNotNull().alias("answerable"), "abstained", "recall_at_k", "reciprocal_rank", "ungrounded_rate", "citation_accuracy", F.coalesce("parse_failed", F.lit(0)).alias("parse_failed"))


def per_family(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.count_if("abstained").alias("abstained"), F.round(F.avg(F.col("abstained").cast("double")), 4).alias("rate"))


def threshold_sweep(scores: DataFrame, steps: int = 20) -> DataFrame:
    """scores (answerable, confidence) -> for each threshold i / steps: answered, false_refusal_rate, abstention_correctness and separation.

    Scores are counted by the highest threshold they reach first, so no row is repeated for each threshold.
    """
    good = F.col("answerable")
    level = F.floor(F.col("confidence") * steps + 1e-9).cast("int")
    reached = scores.groupBy(F.greatest(F.lit(-1), F.least(level, F.lit(steps))).alias("level")).agg(F.count_if(good).alias("g"), F.count_if(~good).alias("a"))
    total = reached.agg(F.sum("g").alias("ng"), F.sum("a").alias("na")).first()
    ng, na = float(total["ng"] or 0), float(total["na"] or 0)
    grid = reached.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    sums = grid.groupBy("i").agg(F.sum(F.when(F.col("level") >= F.col("i"), F.col("g")).otherwise(0)).alias("answered"), F.sum(F.when(F.col("level") < F.col("i"), F.col("a")).otherwise(0)).alias("refused"))
    share = F.col("answered") / F.lit(ng or 1.0)
    right = F.col("refused") / F.lit(na or 1.0)
    return sums.select((F.col("i") / steps).alias("tau"), "answered", F.round(1 - share, 4).alias("false_refusal_rate"), F.round(right, 4).alias("abstention_correctness"), F.round(share + right - 1, 4).alias("separation"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The least threshold of the largest separation."""
    return sweep.orderBy(F.desc("separation"), "tau").limit(1)


def medians(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, median), the mean of the two middle values."""
    middle = lambda n: F.transform(F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1), lambda p, i: F.struct(i.alias("mark"), p.alias("place")))
    return placed(df, value, keys, middle).groupBy(*keys).agg(F.avg("value").alias("median"))


def score_overlap(scores: DataFrame) -> DataFrame:
    """How many adversarial scores reach the least answerable one, with means and medians of both."""
    good, c = F.col("answerable"), F.col("confidence")
    least = scores.where(good).agg(F.min("confidence").alias("least")).first()["least"]
    middle = medians(scores, "confidence", ["answerable"]).agg(F.max(F.when(good, F.col("median"))).alias("g"), F.max(F.when(~good, F.col("median"))).alias("a")).first()
    return scores.agg(F.count_if(~good & (c >= F.lit(least))).alias("overlap"), F.round(F.avg(F.when(good, c)), 4).alias("mean_answerable"), F.round(F.avg(F.when(~good, c)), 4).alias("mean_adversarial"), F.round(F.lit(middle["g"]).cast("double"), 4).alias("median_answerable"), F.round(F.lit(middle["a"]).cast("double"), 4).alias("median_adversarial"))


def diagnosis(sweep: DataFrame, least: float = 0.3) -> DataFrame:
    """The best threshold with what it says of the scorer: `weak` where even there the two kinds of questions are hardly told apart."""
    return best_threshold(sweep).withColumn("diagnosis", F.when(F.col("separation") < least, "weak separation").otherwise("separable"))


def hash_order(*columns: str, seed: str = "42") -> Column:
    """A shuffled order that every engine and every run has alike."""
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def usable_sources(chunks: DataFrame) -> DataFrame:
    """Chunks fit for questions: prose of some length with sentences, not a list of changes or a formal clause."""
    body = F.col("body")
    stops = F.length(body) - F.length(F.replace(body, F.lit("."), F.lit("")))
    marks = F.size(F.regexp_extract_all(body, F.lit(X.HISTORY_MARK), F.lit(0)))
    return chunks.where(F.length(body).between(350, 6000) & (F.col("content_type") == "prose") & ~F.col("clause_title").rlike(X.BAD_TITLE) & ~F.col("heading_path").rlike(X.BAD_PATH) & (stops >= 3) & (marks <= 2))


def stratified_sample(rows: DataFrame, stratum: str, key: str, target: int = 60) -> DataFrame:
    """About target rows, as many of each stratum, in hash order."""
    strata = max(1, rows.select(stratum).distinct().count())
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(key), key))
    kept = rows.withColumn("rank", rank).where(F.col("rank") <= max(1, target // strata))
    return kept.orderBy(hash_order(key), key).limit(target).drop("rank")


def smoke_sample(rows: DataFrame, stratum: str, key: str, per_stratum: int = 3, most: int = 10) -> DataFrame:
    """A few rows of each stratum, topped up from the rest, in hash order."""
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(key), key))
    ranked = rows.withColumn("late", (rank > per_stratum).cast("int"))
    return ranked.orderBy("late", hash_order(key), key).limit(most).drop("late")


def random_sample(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    return rows.orderBy(hash_order(key), key).limit(n)


def renumbered(items: DataFrame, prefix: str = "G") -> DataFrame:
    """Verified items with new ids in order of the old; private columns, whose names start with an underscore, go.

    Items are numbered within ranges of their ids, each after the count of the ranges before it, so no task sees all of them.
    """
    kept = [c for c in items.columns if not c.startswith("_") and c != "id"]
    ranged = items.where("verified_by_human").select("id", *kept).repartitionByRange("id").withColumn("_range", F.spark_partition_id())
    ranged = durable(ranged)
    before, offsets = 0, []
    for row in ranged.groupBy("_range").count().orderBy("_range").collect():
        offsets += [F.lit(row["_range"]), F.lit(before)]
        before += row["count"]
    offset = F.coalesce(F.try_element_at(F.create_map(*offsets), "_range"), F.lit(0)) if offsets else F.lit(0)
    rank = F.row_number().over(W.partitionBy("_range").orderBy("id")) + offset
    return ranged.select(F.format_string(f"{prefix}%03d", rank).alias("id"), *kept)
