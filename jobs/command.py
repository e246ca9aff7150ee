"""What the command lines of the jobs share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def read_config(path: str | None, default: str) -> dict:
    """The job's settings: the file beside the job, or another one."""
    return json.loads(Path(path or Path(__file__).with_name(default)).read_text("utf-8"))


def main(name: str, config: str, paths: dict[str, str], job: Callable[..., object]) -> None:
    """Parse ``--<path>`` arguments and ``--config``, and run ``job(spark, config, **paths)`` in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=job.__doc__)
    for path, told in paths.items():
        parser.add_argument(f"--{path}", required=True, help=told)
    parser.add_argument("--config", help=f"a JSON file; without it {config} beside the job")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        logging.getLogger(name).info("done: %s", job(spark, read_config(given.pop("config"), config), **given))
    finally:
        spark.stop()
