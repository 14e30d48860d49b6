"""Query catalogue: name -> (run(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations


def catalogue() -> dict:
    from . import analytics, cycle, texts

    return {**texts.CATALOGUE, **analytics.CATALOGUE, **cycle.CATALOGUE}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """A table read in fewer splits than the session has cores, a small one, dealt out to all of them;
    any other as it is. For operators that work long on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
