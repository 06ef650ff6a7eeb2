"""Command line over the stored scores: gene, genes and exclude, each as text.

    python -m gneiss.cli FOLDER gene FEATURE
    python -m gneiss.cli FOLDER genes FEATURE FEATURE ..
    python -m gneiss.cli FOLDER exclude WANTED UNWANTED ..
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gneiss.operators import serving
from gneiss.plans.stage import stage
from gneiss.session import local_session

#: The fixed floor of joint queries.
FLOOR = 0.5


def answer(spark: SparkSession, folder: str, command: str, features: Sequence[str], top_n: int = 30) -> DataFrame:
    """The rows that a command prints."""
    serving.checked_request(features, floor=FLOOR, top_n=top_n)
    s, names = stage(spark, folder, "scores"), ("feat", "ent", "score")
    if command == "gene":
        return serving.rank_one(s, features[0], *names, top_n)
    if command == "genes":
        return serving.rank_joint(s, features, *names, floor=FLOOR, top_n=top_n)
    return serving.rank_excluding(s, features[:1], features[1:], *names, top_n=top_n)


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("folder")
    parser.add_argument("command", choices=["gene", "genes", "exclude"])
    parser.add_argument("features", nargs="+")
    parser.add_argument("--top", type=int, default=30)
    given = parser.parse_args(arguments)
    rows = answer(local_session("cli"), given.folder, given.command, given.features, given.top)
    print("\t".join(rows.columns))
    for r in rows.collect():
        print("\t".join(str(x) for x in r))


if __name__ == "__main__":
    main()
