"""What both jobs share: arguments, configuration and a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("symloom.jobs")


def settings(name: str, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """The settings of ``jobs/<name>.json``, those given in their place; an unknown
    one is an error."""
    known = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    if unknown := set(given or {}) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return known | (given or {})


def main(name: str, doc: str, arguments: tuple[str, ...], run: Callable[..., dict[str, Any]]) -> None:
    """Command line: paths, and a JSON file of settings that differ."""
    parser = argparse.ArgumentParser(description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    for a in arguments:
        parser.add_argument(f"--{a}", required=True)
    parser.add_argument("--config", help=f"a JSON file of settings in place of those of {name}.json")
    args = vars(parser.parse_args())
    given = json.loads(Path(args.pop("config")).read_text()) if args.get("config") else (args.pop("config", None) or {})
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, *[args[a] for a in arguments], given)
    finally:
        spark.stop()
