"""What the jobs share: configs, derived columns, logging, the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("pointfield.jobs")
HERE = os.path.dirname(os.path.abspath(__file__))


def config(name: str) -> dict:
    """A config file beside the jobs, or one of the user's own by its path."""
    with open(name if os.path.sep in name else os.path.join(HERE, name)) as f:
        return json.load(f)


def derived(df: DataFrame, levels: list[dict[str, str]]) -> DataFrame:
    """``df`` with columns of SQL expressions; those of a level may use those of the levels before."""
    for level in levels:
        df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in level.items()])
    return df


def derived_sql(source: str, levels: list[dict[str, str]]) -> str:
    for level in levels:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in level.items())} FROM {source})"
    return source


def command(about: str, work: Callable, defaults: str, *paths: str) -> None:
    """Run ``work(spark, *paths, config)`` from a command line of its own session."""
    p = argparse.ArgumentParser(description=about)
    for name in paths:
        p.add_argument(f"--{name}", required=True, help="a path that Spark reads or writes")
    p.add_argument("--config", default=defaults, help="a JSON file")
    given = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, *[getattr(given, name) for name in paths], config(given.config))
    finally:
        spark.stop()
