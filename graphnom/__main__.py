"""Command line: python -m graphnom embed|nominate DIR, or resample DIR with the harness's options.

DIR holds params.json (settings; all have defaults), the edge list and the attribute table that it names; results are
written into it.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphnom import config as settings
from graphnom.functions.text import timed
from graphnom.plans import nomination
from graphnom.plans.embeddings import embed
from graphnom.sources import readers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphnom")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("embed", "nominate", "resample"):
        one = commands.add_parser(name)
        one.add_argument("path")
        if name == "resample":
            one.add_argument("--attr", "-a", required=True, help="attribute value")
            one.add_argument("--attr_type", "-t", required=True, help="attribute type")
            one.add_argument("--pos_seeds", "-p", type=int, default=50)
            one.add_argument("--neg_seeds", "-n", type=int, default=50)
            one.add_argument("--num_samples", "-S", type=int, default=50)
            one.add_argument("--top", type=int, default=1000)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("graphnom").getOrCreate()
    own = f"{given.path}/params.json"
    config = settings.load(spark, own) if readers.exists(spark, own) else settings.Config()
    say = print if config.verbose else lambda *_: None
    edges = readers.read_edges(spark, f"{given.path}/{config.edges_filename}")
    attributes = readers.read_attributes(spark, f"{given.path}/{config.attr_filename}")
    if given.command == "embed":
        timed(embed, say)(spark, edges, attributes, config, given.path)
    elif given.command == "nominate":
        timed(nomination.run, say)(spark, edges, attributes, config, given.path)
    else:
        config = config.with_(nomination_type=given.attr_type, nomination_value=given.attr)
        timed(nomination.harness, say)(spark, edges, attributes, config, given.pos_seeds, given.neg_seeds, given.num_samples, given.top, folder=given.path)


if __name__ == "__main__":
    main()
