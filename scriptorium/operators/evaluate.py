"""Metrics of answers, their aggregates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as fx


def char_f1(rows: DataFrame, key: str, prediction: str, gold: str) -> DataFrame:
    """(key, char_f1): F1 of character pairs as multisets, white space gone; 0 if either side has none. Keys are unique.

    Pairs are counted for each side and met by (key, pair); nothing compares lists.
    """
    side = lambda c, n: rows.select(key, F.explode(fx.gram_list(fx.squash(F.coalesce(F.col(c), F.lit(""))), 2)).alias("gram"), F.lit(n).alias("side"))
    counts = side(prediction, 0).unionByName(side(gold, 1)).groupBy(key, "gram").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("g"))
    sums = counts.groupBy(key).agg(F.sum(F.least("p", "g")).alias("both"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    f1 = F.when(F.col("both") > 0, F.round(2.0 * F.col("both") / (F.col("np") + F.col("ng")), 3)).otherwise(0.0)
    return rows.select(key).join(sums.select(key, f1.alias("char_f1")), key, "left").select(key, F.coalesce("char_f1", F.lit(0.0)).alias("char_f1"))


def num_hit(prediction: Column, gold: Column) -> Column:
    """Share of the gold numbers in the prediction; null if gold has none."""
    g = fx.plain_numbers(gold)
    return F.when(F.size(g) > 0, F.round(F.size(F.array_intersect(g, fx.plain_numbers(prediction))) / F.size(g), 3))


def len_ratio(prediction: Column, gold: Column) -> Column:
    return F.round(F.length(prediction) / F.greatest(F.lit(1), F.length(gold)), 2)


def refused(prediction: Column, gold: Column, pattern: str = fx.REFUSAL) -> Column:
    """A refusal that the gold answer isn't."""
    return F.rlike(prediction, F.lit(pattern)) & ~F.rlike(gold, F.lit(pattern))


def cell_summary(rows: DataFrame) -> DataFrame:
    """model, cell, n, char_f1, num_hit, n_with_numbers, refused, len_ratio of scored rows; nulls don't count."""
    return rows.groupBy("model", "cell").agg(
        F.count("*").alias("n"), F.round(F.avg("char_f1"), 3).alias("char_f1"), F.round(F.avg("num_hit"), 3).alias("num_hit"),
        F.count("num_hit").alias("n_with_numbers"), F.count_if("refused").alias("refused"), F.round(F.avg("len_ratio"), 2).alias("len_ratio"),
    )


def cell_pivot(summary: DataFrame, models: tuple[str, str] = ("before", "after"), value: str = "char_f1") -> DataFrame:
    """cell, before, after as text; a missing side is a dash."""
    wide = summary.groupBy("cell").pivot("model", list(models)).agg(F.first(value))
    return wide.select("cell", *[F.coalesce(F.col(m).cast("string"), F.lit("-")).alias(m) for m in models])


def hit_rate(flag: Column) -> Column:
    """Hits over rows that aren't blank, as x/y; a dash if all are."""
    total = F.count_if(flag.isNotNull() & (flag != ""))
    return F.when(total > 0, F.concat(F.count_if(flag == "1").cast("string"), F.lit("/"), total.cast("string"))).otherwise("—")


def ratio_mean(c: Column) -> Column:
    """Mean of ratios written a/b."""
    part = F.split(c, "/")
    return F.avg(F.try_element_at(part, F.lit(1)).try_cast("double") / F.greatest(F.lit(1.0), F.try_element_at(part, F.lit(2)).try_cast("double")))


def verdict_score(rows: DataFrame, verdict: str) -> DataFrame:
    """score, most: the sum of judged verdicts over twice their number."""
    return rows.agg(F.coalesce(F.sum(F.col(verdict)), F.lit(0)).cast("long").alias("score"), (F.count(verdict) * 2).alias("most"))


def gold_rank(ranked: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(qid, gold_rank) of the first retrieved row that a gold locator names; null if none is."""
    hits = ranked.join(gold.select("qid", *keys).distinct(), ["qid", *keys]).groupBy("qid").agg(F.min("rank").alias("gold_rank"))
    return gold.select("qid").distinct().join(hits, "qid", "left")


def index_quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: the value at index int(n * share) of the sorted values for each share, and the maximum.

    Values are counted first, so the running sum goes over distinct values only.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(value).agg(F.count("*").alias("c"))
    running = counts.select(F.col(value).alias("v"), F.sum("c").over(Window.orderBy(value)).alias("upto"))
    n = rows.agg(F.count("*").alias("n"))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * s), F.col("v"))).alias(f"p{round(s * 100)}") for s in shares]
    return running.crossJoin(F.broadcast(n)).agg(*picks, F.max("v").alias("max"), F.max("n").alias("n"))


def freeze_hash(questions: DataFrame) -> DataFrame:
    """sha256 of the canonical JSON of questions(id, type, question, must_refuse): rows by the number in their id, keys sorted."""
    number = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    row = F.struct("id", "must_refuse", "question", "type")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), row.alias("row")))), lambda x: x["row"])
    return questions.agg(F.sha2(F.to_json(rows), 256).alias("digest"))


def question_problems(questions: DataFrame, total: int = 10, cross: int = 2) -> DataFrame:
    """Violations of the question set's rules; none for a sound set."""
    scored = ~F.col("type").startswith("附加")
    facts = questions.agg(
        F.count_if(scored).alias("n"), F.count_if(scored & F.contains("type", F.lit("跨公司"))).alias("x"), (F.count("question") - F.count_distinct("question")).alias("same"),
        F.count_if(F.col("id").isNull() | F.col("type").isNull() | F.col("question").isNull() | F.col("must_refuse").isNull()).alias("nulls"),
    )
    checks = {"missing_key": F.col("nulls") > 0, "count": F.col("n") != total, "cross_company": F.col("x") < cross, "repeated": F.col("same") > 0}
    return facts.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())).alias("problem"))


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row: a report table as Markdown; reports are aggregates, a row for each cell or type."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("t")))), lambda x: x["t"]), "\n")
    return rows.agg(F.concat(F.lit(head), body).alias("markdown"))
