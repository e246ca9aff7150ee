"""Keeps a search index of texts up to date: takes the files that are new, tokenises each text once.

    python -m jobs.term_index --source <folder of Parquet files> --output <folder> --checkpoint <folder>

The output has ``postings`` and ``texts`` (see ``brindle.streaming.term_index``,
whose ``search`` answers queries from them).  The checkpoint says which files
were taken; a run that was cut short is taken up at the batch it had begun, which
overwrites what there is of it.  Run again without new files, it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from brindle.streaming import term_index
from jobs.command import main, read_config

CONFIG = "term_index.json"


def run(spark: SparkSession, config: dict, source: str, output: str, checkpoint: str) -> dict[str, int]:
    """Index the new files of a folder."""
    return term_index.ingest(spark, source, output, checkpoint, settings(config))


def settings(config: dict | None = None) -> term_index.Settings:
    config = read_config(None, CONFIG) if config is None else config
    return term_index.Settings(**config | {"keep": tuple(config.get("keep", ()))})


if __name__ == "__main__":
    main("term_index", CONFIG, {"source": "folder or file of Parquet, which may grow", "output": "folder of the index", "checkpoint": "folder of the stream's checkpoint"}, run)
