"""python -m galewatch poll|reprocess|sites: rounds over due sites, a range of days again, the site list.

Decoders and scorers are named as module:object. Settings come from GALEWATCH_* environment variables.
"""

from __future__ import annotations

import argparse
from datetime import datetime
from importlib import import_module


def named(name: str):
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="galewatch", description=__doc__.splitlines()[0])
    parser.add_argument("--locations", help="file of radar locations; the core sites alone without")
    commands = parser.add_subparsers(dest="command", required=True)
    work = argparse.ArgumentParser(add_help=False)
    work.add_argument("--archive", required=True, help="folder of volumes, yyyy/mm/dd/SITE below it")
    work.add_argument("--decoder", required=True, help="module:function that decodes a volume")
    work.add_argument("--scorer", required=True, help="module:object that makes a scorer")
    work.add_argument("--sites", nargs="*", help="site ids; all of the catalog without")
    poll = commands.add_parser("poll", parents=[work], help="rounds over the sites that are due")
    poll.add_argument("--folder", required=True, help="folder of the loop's state and results")
    poll.add_argument("--rounds", type=int, help="how many; without end by default")
    poll.add_argument("--worker", default="0/1", metavar="K/N", help="the sites of one of N processes, K from 0")
    poll.add_argument("--overwrite", action="store_true", help="every site is due at first")
    again = commands.add_parser("reprocess", parents=[work], help="a site's scans of a range of days")
    again.add_argument("--site", required=True)
    again.add_argument("--start", required=True, type=datetime.fromisoformat)
    again.add_argument("--end", type=datetime.fromisoformat)
    again.add_argument("--out", required=True)
    commands.add_parser("sites", help="the site list, tab-separated")
    args = parser.parse_args(arguments)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from galewatch.config import EngineConfig
    from galewatch.plans import polling
    from galewatch.sources import sites as catalog

    spark = SparkSession.builder.appName("galewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = catalog.read_locations(spark, args.locations) if args.locations else None
    known = catalog.build_catalog(spark, found, include_terminal=EngineConfig.from_env().include_tdwr)
    if args.command == "sites":
        lines = [r["line"] for r in catalog.listing(known).collect()]  # one for each radar
        print("\n".join([*lines, f"{len(lines)} sites"]))
        return
    if args.sites:
        asked = spark.createDataFrame([(s.strip().upper(),) for s in args.sites], "site string")
        catalog.require_known(asked, known)
        known = known.where(F.col("site_id").isin([s.strip().upper() for s in args.sites]))
    tools = named(args.decoder), named(args.scorer), EngineConfig.from_env()
    if args.command == "poll":
        folder, known = polling.share(spark, args.folder, known, *map(int, args.worker.split("/")))
        polling.run(spark, args.archive, folder, known, *tools, rounds=args.rounds, overwrite=args.overwrite)
    else:
        polling.reprocess(spark, args.archive, args.out, args.site, args.start, args.end or args.start, known, *tools)


if __name__ == "__main__":
    main()
