"""Curation of records: aliases, near duplicates, splits, samples, reviews, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.checkpoints import cut
from scriptorium.operators import near


def shuffled(seed: int, *keys: Column) -> Column:
    """Order by a keyed digest: the same everywhere, as good as random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def alias_of(rows: DataFrame, identity: Column, key: str) -> DataFrame:
    """Adds alias_of: the smallest key of the rows of equal identity, null on that row itself.

    Sums by identity are made before the shuffle and joined back, so an identity
    that many rows share isn't gathered in one task.
    """
    tagged = rows.withColumn("_identity", identity)
    first = tagged.groupBy("_identity").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = tagged.join(first, "_identity", "left")
    return joined.withColumn("alias_of", F.when(F.col("_first") < F.col(key), F.col("_first"))).drop("_identity", "_first")


def greedy_near_dup(rows: DataFrame, group: str, order: str, text: Column, threshold: float = 0.8) -> DataFrame:
    """Adds kept: in order, a row goes if it is too similar to an earlier row of its group that was kept.

    A dropped row drops nothing. Of rows with equal sets of 3-grams only the first
    can stay, and what it is similar to the others are too, so the others go first.
    Two rounds then keep what no earlier open row may be similar to and drop what
    that is similar to, so near copies of one row meet that row, not each other.
    Of the few rows left, all similar pairs are found, and rounds decide every row
    whose earlier similar rows are decided. Rows without group, order or grams stay.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold has to lie between 0 and 1")
    keyed = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), text.alias("t")).where("g IS NOT NULL AND o IS NOT NULL")
    sets = cut(near.sketched(keyed))
    firsts = cut(sets.groupBy("g", "same").agg(F.min("o").alias("o")))
    dropped = sets.select("g", "same", "o").join(firsts, ["g", "same", "o"], "left_anti").select("g", "o")
    ids = cut(firsts.select("g", "o").distinct().orderBy("o").withColumn("id", F.monotonically_increasing_id()))
    still = cut(sets.join(firsts, ["g", "same", "o"], "left_semi").join(ids, ["g", "o"]).select("id", "g", "n", "sketch"))
    texts = None
    for _ in range(2):
        late = cut(near.waiting(still, threshold))
        if late.isEmpty():
            break
        flagged = still.join(late.withColumn("waits", F.lit(True)), "id", "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
        pairs = cut(near.freed(flagged, threshold))
        if texts is None:
            listed = cut(ids.join(late.union(pairs.select("i")).distinct(), "id", "left_semi"))
            texts = cut(near.keep_listed(keyed, listed, ["g", "o"]).join(listed, ["g", "o"]).select("id", "t"))
        gone = cut(near.confirmed(pairs, texts, threshold).select(F.col("j").alias("id")).distinct())
        dropped = dropped.unionByName(ids.join(gone, "id").select("g", "o"))
        still = cut(still.join(late, "id", "left_semi").join(gone, "id", "left_anti"))
    else:
        full = near.with_grams(texts.join(still.select("id"), "id", "left_semi"))
        dropped = dropped.unionByName(ids.join(_passed_over(cut(near.exact_pairs(still.join(full, "id"), threshold))), "id").select("g", "o"))
    marks = dropped.distinct().select(F.col("g").alias(group), F.col("o").alias(order), F.lit(False).alias("_kept"))
    return rows.join(marks, [group, order], "left").withColumn("kept", F.coalesce("_kept", F.lit(True))).drop("_kept")


def _passed_over(pairs: DataFrame) -> DataFrame:
    """The ids that go, of pairs(i, j) that are similar, i the earlier."""
    out = pairs.select(F.col("j").alias("id")).limit(0)
    while True:
        # Rows that nothing open stands before are kept; what they are similar to goes.
        free = pairs.select("i").distinct().join(pairs.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        gone = cut(pairs.join(free, "i").select(F.col("j").alias("id")).distinct())
        if gone.isEmpty():
            return out
        out = out.unionByName(gone)
        rest = pairs.join(free, "i", "left_anti").join(gone.withColumnRenamed("id", "i"), "i", "left_anti")
        pairs = cut(rest.join(gone.withColumnRenamed("id", "j"), "j", "left_anti"))


def _numbered(rows: DataFrame, strata: Column, order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(strata).orderBy(*order)).cast("long"))


def stratified_split(rows: DataFrame, strata: Column, key: str, ratio: float = 0.15, seed: int = 20260924) -> DataFrame:
    """Adds split: of each stratum of three keys or more round(ratio * n), one at least, are test; the keys are the unit."""
    keys = rows.select(strata.alias("_stratum"), key).distinct()
    sized = keys.join(keys.groupBy("_stratum").agg(F.count("*").alias("_n")), "_stratum")
    ranked = _numbered(sized, F.col("_stratum"), [shuffled(seed, F.col(key)), F.col(key)], "_r")
    n_test = F.when(F.col("_n") >= 3, F.greatest(F.lit(1), F.bround(F.col("_n") * ratio))).otherwise(0)
    split = ranked.select("_stratum", key, F.when(F.col("_r") <= n_test, "test").otherwise("train").alias("split"))
    return rows.withColumn("_stratum", strata).join(split, ["_stratum", key]).drop("_stratum")


def balanced_sample(rows: DataFrame, group: str, key: str, per_group: int, seed: int = 20260924) -> DataFrame:
    """The first ``per_group`` rows of each group in shuffled order."""
    return _numbered(rows, F.col(group), [shuffled(seed, F.col(key)), F.col(key)], "_r").where(F.col("_r") <= per_group).drop("_r")


def review_sample(rows: DataFrame, strata: Column, key: str, edge: list[Column], size: int = 40, per_stratum: int = 3, edges: int = 10, seed: int = 20260924) -> DataFrame:
    """``size`` rows for review with their reason: some of each stratum, then edge cases, then shuffled others."""
    mixed = shuffled(seed, F.col(key))
    ranked = _numbered(rows, strata, [mixed, F.col(key)], "_r")
    first = ranked.where(F.col("_r") <= per_stratum).select(key, F.lit(1).alias("priority"), mixed.alias("_o"))
    edge_rows = rows.orderBy(*edge, key).limit(edges).select(key, F.lit(2).alias("priority"), mixed.alias("_o"))
    rest = rows.select(key, F.lit(3).alias("priority"), mixed.alias("_o"))
    best = first.unionByName(edge_rows).unionByName(rest).groupBy(key).agg(F.min("priority").alias("priority"), F.first("_o").alias("_o"))
    return best.orderBy("priority", "_o", key).limit(size).select(key, "priority")


def apply_review(rows: DataFrame, deletions: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(deletions.select(*keys).distinct(), keys, "left_anti")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed stage has still to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def project(rows: DataFrame, whitelist: list[str]) -> DataFrame:
    return rows.select(*[c for c in whitelist if c in rows.columns])


def append_citation(answer: Column, label: Column) -> Column:
    """Idempotent: an answer that has one stays."""
    return F.when(F.contains(F.coalesce(answer, F.lit("")), F.lit("依据：")), answer).otherwise(F.concat(F.regexp_replace(answer, r"(?U)\s+$", ""), F.lit("\n"), label))


def split_leaks(split: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; must be empty."""
    return split.where("split = 'train'").select(key).intersect(split.where("split = 'test'").select(key))
