"""Retrieval, refusal and latency metrics over outcome tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions.text import plain


def part_of(part_id: Column) -> Column:
    return F.when(part_id.contains("cabinet"), "cabinet-resolution").otherwise("decree-law")


def gold_ranks(labels: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, gold_rank): the first ranked row with the label's law and article, and its part where the label names one.

    A ranking without a ``qid`` is that of every question. Only the best rank of each law, article and part meets the labels.
    """
    on = [c for c in ("qid", "law_id", "article_no") if c in ranked.columns]
    of_part = ranked.groupBy(*on, part_of(F.col("part_id")).alias("part")).agg(F.min("rank").alias("rank"))
    of_any = of_part.groupBy(*on).agg(F.min("rank").alias("rank")).withColumn("part", F.lit(None).cast("string"))
    best = of_part.unionByName(of_any)
    same = reduce(lambda x, c: x & (F.col(f"l.{c}") == F.col(f"r.{c}")), on, F.col("l.part").eqNullSafe(F.col("r.part")))
    return labels.alias("l").join(best.alias("r"), same, "left").groupBy(F.col("l.qid").alias("qid")).agg(F.min("r.rank").alias("gold_rank"))


def phrase_ranks(labels: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, gold_rank): the first ranked row whose text holds the phrase, whatever its spacing and case."""
    joined = labels.select("qid", "must_contain").join(ranked.select("qid", "rank", "text"), "qid", "left")
    return joined.groupBy("qid").agg(F.min(F.when(plain(F.col("text")).contains(plain(F.col("must_contain"))), F.col("rank"))).alias("gold_rank"))


def metrics(outcomes: DataFrame, top_k: int = 5, by: str = "config") -> DataFrame:
    """Per configuration, of (answerable, gold_rank, retrieved, refused) rows: the reported shares; null for an empty side.

    Context precision is 1 / retrieved for a found label, as the published figures are.
    """
    yes, trap, rank = F.col("answerable"), ~F.col("answerable"), F.col("gold_rank")
    mean = lambda value, side: F.avg(F.when(side, value.cast("double")))
    return outcomes.groupBy(by).agg(
        F.count_if(yes).alias("answerable"), F.count_if(trap).alias("traps"),
        mean(F.coalesce(rank == 1, F.lit(False)), yes).alias("hit_rate_at_1"),
        mean(F.coalesce(rank <= top_k, F.lit(False)), yes).alias("hit_rate_at_5"),
        mean(F.coalesce(1.0 / rank, F.lit(0.0)), yes).alias("mrr"),
        mean(F.when(rank.isNotNull() & (F.col("retrieved") > 0), 1.0 / F.col("retrieved")).otherwise(0.0), yes).alias("context_precision"),
        mean(rank.isNotNull(), yes).alias("context_recall"),
        mean(F.col("refused"), trap).alias("refusal_accuracy"),
        F.count_if(trap & ~F.col("refused")).alias("missed_refusals"), F.count_if(yes & F.col("refused")).alias("false_refusals"),
    )


def nearest_rank(values: Column, share: float) -> Column:
    """The element of sorted values at floor(n * share), the last at most."""
    n = F.size(values)
    return F.element_at(values, (F.least(n - 1, F.floor(n * share)) + 1).cast("int"))


def latency_summary(outcomes: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """p50 (the true median), p95 (nearest rank) and max, to one place.

    The 95th value comes from a rank within the group instead of a collected list, so a group of any size does.
    """
    order = Window.partitionBy(*by).orderBy(value)
    per = outcomes.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * 0.95))
    return per.groupBy(*by).agg(F.round(F.median(value), 1).alias("p50_ms"), F.round(F.max(F.when(F.col("_i") == at, F.col(value))), 1).alias("p95_ms"), F.round(F.max(value), 1).alias("max_ms"))


def upper_median(outcomes: DataFrame, by: list[str], value: str = "latency_ms") -> DataFrame:
    """The element at n // 2 of the sorted values."""
    order = Window.partitionBy(*by).orderBy(value)
    per = outcomes.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return per.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(*by, F.col(value).alias("p50_ms"))


def calibrated_floor(outcomes: DataFrame, by: str = "config") -> DataFrame:
    """The refusal floor midway between the worst answerable and the best trap; no row where a side is empty."""
    per = outcomes.where("best_score IS NOT NULL").groupBy(by).agg(F.min(F.when(F.col("answerable"), F.col("best_score"))).alias("lo"), F.max(F.when(~F.col("answerable"), F.col("best_score"))).alias("hi"))
    per = per.where("lo IS NOT NULL AND hi IS NOT NULL")
    return per.select(by, F.round("lo", 3).alias("answerable_min"), F.round("hi", 3).alias("trap_max"), F.round(F.col("lo") - F.col("hi"), 3).alias("separation"), F.round((F.col("lo") + F.col("hi")) / 2, 3).alias("floor"))


def faithfulness(claims: DataFrame) -> DataFrame:
    """Per question the share of judged claims that are supported; questions without claims have no row."""
    return claims.groupBy("qid").agg(F.count("*").alias("claims"), F.avg(F.col("supported").cast("double")).alias("faithfulness"))


def answer_relevance(pairs: DataFrame) -> DataFrame:
    """Per question the mean cosine of its vector ``qv`` with those of generated questions ``gv``; zero vectors count 0, none gives 0."""
    from lodestone.operators.dense import dot, doubles, norm

    q, g = doubles(F.col("qv")), doubles(F.col("gv"))
    cosine = F.when(F.col("gv").isNull(), F.lit(None)).when((norm(q) == 0) | (norm(g) == 0), 0.0).otherwise(dot(q, g) / (norm(q) * norm(g)))
    return pairs.groupBy("qid").agg(F.coalesce(F.round(F.avg(cosine), 6), F.lit(0.0)).alias("relevance"))


def group_relevance(vectors: DataFrame) -> DataFrame:
    """(qid, relevance) of every (qid, v, group) row: the mean cosine with the other vectors of its group, by sums of unit vectors, so no pairs are formed.

    Ids are unique and vectors of one length; zero vectors count 0, null ones don't count, and none other in the group gives 0.
    """
    from lodestone.operators.dense import dot, doubles, norm

    rows = vectors.select("qid", "group", doubles(F.col("v")).alias("v"))
    parts = rows.select("group", norm(F.col("v")).alias("length"), F.posexplode("v").alias("at", "x"))
    part = F.when(F.col("length") == 0, 0.0).otherwise(F.col("x") / F.col("length"))
    sums = parts.groupBy("group", "at").agg(F.sum(part).alias("total"), F.count("*").alias("n"))
    sums = sums.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda s: s["total"]).alias("total"), F.max("n").alias("n"))
    length = norm(F.col("v"))
    mean = F.when(length == 0, 0.0).otherwise(dot(F.col("v"), F.col("total")) / length - 1) / F.when(F.col("n") > 1, F.col("n") - 1)
    return rows.join(sums, "group", "left").select("qid", F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("relevance"))


def label_problems(labels: DataFrame, articles: DataFrame) -> DataFrame:
    """(qid, problem): duplicate questions, answerable labels without such an article, keywords that it lacks.

    Labels: qid, question, answerable, law_id, article_no, part, must_contain (array). Articles: law_id, article_no, part, text.
    """
    same = Window.partitionBy(F.lower(F.trim("question"))).orderBy("qid")
    twice = labels.withColumn("_i", F.row_number().over(same)).where("_i > 1").select("qid", F.lit("duplicate question").alias("problem"))
    asked, key = labels.where("answerable"), ["law_id", "article_no", "part"]
    absent = asked.join(articles.select(*key).distinct(), key, "left_anti").select("qid", F.lit("no such article").alias("problem"))
    held = asked.join(articles.select(*key, F.lower("text").alias("_text")), key)
    lacks = held.withColumn("_missing", F.filter("must_contain", lambda t: ~F.col("_text").contains(F.lower(t)))).where(F.size("_missing") > 0)
    return twice.unionByName(absent).unionByName(lacks.select("qid", F.concat(F.lit("lacks "), F.array_join("_missing", ", ")).alias("problem")))


def quality_gate(scored: DataFrame) -> DataFrame:
    """(metric, value, floor, passed) of one row of ``metrics``; a missing value fails, and no false refusal is allowed."""
    spark = scored.sparkSession
    names = [n for n, _ in fixed.QUALITY_FLOORS]
    long = scored.select(F.expr(f"stack({len(names) + 1}, " + ", ".join(f"'{n}', cast({n} as double)" for n in [*names, "false_refusals"]) + ") as (metric, value)"))
    floors = spark.createDataFrame([*[(n, f) for n, f in fixed.QUALITY_FLOORS], ("false_refusals", float(fixed.MAX_FALSE_REFUSALS))], "metric string, floor double")
    good = F.when(F.col("metric") == "false_refusals", F.coalesce("value", F.lit(0.0)) <= F.col("floor")).otherwise(F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)))
    return floors.join(long, "metric", "left").withColumn("passed", good)


def budget_problems(lines: DataFrame, budget_mb: int = fixed.BUDGET_MB) -> DataFrame:
    """(stage, peak_mb, problem) of a build log's lines: expected stages that are missing, stages over the budget."""
    stage, mb = F.regexp_extract("line", fixed.BUDGET_LINE, 1), F.regexp_extract("line", fixed.BUDGET_LINE, 2)
    peaks = lines.where(F.col("line").rlike(fixed.BUDGET_LINE)).groupBy(stage.alias("stage")).agg(F.max(mb.cast("double")).alias("peak_mb"))
    expected = lines.sparkSession.createDataFrame([(s,) for s in fixed.BUDGET_STAGES], "stage string")
    problem = F.when(F.col("peak_mb").isNull(), "missing").when(F.col("peak_mb") > budget_mb, "over budget")
    return expected.join(peaks, "stage", "full_outer").withColumn("problem", problem).where("problem IS NOT NULL")


def law_counts(chunks: DataFrame) -> DataFrame:
    """Per law: chunks, and distinct (part, article)."""
    return chunks.groupBy("law_id").agg(F.count("*").alias("chunks"), F.count_distinct("part_id", "article_no").alias("articles"))
