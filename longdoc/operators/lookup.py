"""Title map, join and lookup (J1-J3) and the quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title_map(meta: DataFrame, key: str = "id", value: str = "title", ord_col: str = "ord") -> DataFrame:
    """One title per id; a duplicate id keeps the **last** line (max ord).
    Partial aggregation per map task, then one shuffle on the id."""
    return meta.groupBy(key).agg(F.max_by(value, ord_col).alias(value))


def title_first(meta: DataFrame, key: str = "id", value: str = "title", ord_col: str = "ord") -> DataFrame:
    """J3 helper: the **first** line of each id (min ord)."""
    return meta.groupBy(key).agg(F.min_by(value, ord_col).alias(value))


def join_titles(articles: DataFrame, titles: DataFrame, key: str = "article_id",
                tkey: str = "id") -> DataFrame:
    """Inner equi-join; articles without a title are dropped. No hint: AQE
    turns it into a broadcast join only when the runtime size is small."""
    t = title_map(titles, tkey).withColumnRenamed(tkey, key)
    return articles.join(t, key, "inner")


def lookup_title(ids: DataFrame, titles: DataFrame, key: str = "article_id",
                 tkey: str = "id") -> DataFrame:
    """First match wins, NULL when none (left join)."""
    t = title_first(titles, tkey).withColumnRenamed(tkey, key)
    return ids.join(t, key, "left")


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Evaluate every check (True = bad) once per row; ``error`` lists the
    failing check names. Returns (good, bad); the job continues with ``good``."""
    names = list(checks)
    err = F.concat_ws(",", *[F.when(checks[n], F.lit(n)) for n in names])
    tagged = df.withColumn("error", F.when(err != "", err))
    return tagged.where(F.col("error").isNull()).drop("error"), tagged.where(F.col("error").isNotNull())


def tag_errors(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    names = list(checks)
    err = F.concat_ws(",", *[F.when(checks[n], F.lit(n)) for n in names])
    return df.withColumn("error", F.when(err != "", err))
