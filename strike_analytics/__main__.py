"""Command-line front end: the service's endpoints as one-shot Spark queries.

    python -m strike_analytics recent   --strikes PATH [--minutes 60] [--limit 100] [--now TS]
    python -m strike_analytics list     --strikes PATH [--limit ..] [--offset ..] [--since ..] [--until ..]
                                        [--min-lat ..] [--max-lat ..] [--min-lon ..] [--max-lon ..]
    python -m strike_analytics nearby   --strikes PATH --lat LAT --lon LON [--radius 50] [--minutes 60]
                                        [--limit 100] [--recency-prelimit]
    python -m strike_analytics stats    --strikes PATH [--since ..] [--until ..]
    python -m strike_analytics health   --strikes PATH
    python -m strike_analytics latest   --strikes PATH [--limit 5]
    python -m strike_analytics miles    --strikes PATH [--minutes 60] [--now TS]
    python -m strike_analytics hemisphere|hourly --strikes PATH [--hours ..] [--now TS]
    python -m strike_analytics ingestion --outcomes PATH       (the decoded log)
    python -m strike_analytics report   --frames PATH          (the lenient decoder's)
    python -m strike_analytics ingest   --frames PATH --root PATH --batch-id ID

Results are bounded (top-k or aggregates) and printed as JSON lines.
``--now`` defaults to the current UTC time.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession

from .operators import aggregates as A
from .operators import ingest_stats as I
from .operators import queries as Q
from .operators.decode import decode_frames
from .sources.tables import ingest_batch, read_frames, read_outcomes, read_strikes


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strike_analytics")
    p.add_argument("--master", default=None, help="local[N] for a local run; omit under spark-submit")
    sub = p.add_subparsers(dest="cmd", required=True)

    def strikes(name):
        s = sub.add_parser(name)
        s.add_argument("--strikes", required=True)
        s.add_argument("--now", default=None)
        return s

    s = strikes("recent")
    s.add_argument("--minutes", type=int, default=60)
    s.add_argument("--limit", type=int, default=100)
    s = strikes("list")
    for a, t in (("--limit", int), ("--offset", int), ("--since", str), ("--until", str),
                 ("--min-lat", float), ("--max-lat", float), ("--min-lon", float), ("--max-lon", float)):
        s.add_argument(a, type=t, default=None)
    s = strikes("nearby")
    s.add_argument("--lat", type=float, required=True)
    s.add_argument("--lon", type=float, required=True)
    s.add_argument("--radius", type=float, default=50)
    s.add_argument("--minutes", type=int, default=60)
    s.add_argument("--limit", type=int, default=100)
    s.add_argument("--recency-prelimit", action="store_true")
    s = strikes("stats")
    s.add_argument("--since", default=None)
    s.add_argument("--until", default=None)
    strikes("health")
    strikes("latest").add_argument("--limit", type=int, default=5)
    strikes("miles").add_argument("--minutes", type=int, default=60)
    strikes("hemisphere").add_argument("--hours", type=int, default=1)
    strikes("hourly").add_argument("--hours", type=int, default=24)
    s = sub.add_parser("report")
    s.add_argument("--frames", required=True)
    s = sub.add_parser("ingestion")
    s.add_argument("--outcomes", required=True)
    s = sub.add_parser("ingest")
    s.add_argument("--frames", required=True)
    s.add_argument("--root", required=True)
    s.add_argument("--batch-id", required=True)
    return p


def run(argv: list[str]) -> list[dict]:
    args = _parser().parse_args(argv)
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    now = getattr(args, "now", None) or dt.datetime.now(dt.timezone.utc)
    if args.cmd == "ingest":
        ingest_batch(read_frames(spark, args.frames), args.root, args.batch_id)
        return [{"ingested_batch": args.batch_id, "root": args.root}]
    if args.cmd == "ingestion":
        df = I.ingestion_stats(read_outcomes(spark, args.outcomes))
    elif args.cmd == "report":
        df = I.decode_report(decode_frames(read_frames(spark, args.frames), "lenient"))
    else:
        strikes = read_strikes(spark, args.strikes)
        if args.cmd == "recent":
            df = Q.recent_strikes(strikes, now=now, minutes=args.minutes, limit=args.limit)
        elif args.cmd == "list":
            kw = {k: v for k, v in dict(limit=args.limit, offset=args.offset, since=args.since,
                                        until=args.until, min_lat=args.min_lat, max_lat=args.max_lat,
                                        min_lon=args.min_lon, max_lon=args.max_lon).items()
                  if v is not None}
            df = Q.list_strikes(strikes, **kw)
        elif args.cmd == "nearby":
            df = Q.nearby_strikes(strikes, now=now, lat=args.lat, lon=args.lon, radius=args.radius,
                                  minutes=args.minutes, limit=args.limit, recency_prelimit=args.recency_prelimit)
        elif args.cmd == "stats":
            df = A.strike_stats(strikes, since=args.since, until=args.until)
        elif args.cmd == "latest":
            df = Q.latest_strikes(strikes, args.limit)
        elif args.cmd == "miles":
            df = Q.nearest_strikes_miles(strikes, now=now, minutes=args.minutes)
        elif args.cmd == "hemisphere":
            df = A.hemisphere_activity(strikes, now=now, hours=args.hours)
        elif args.cmd == "hourly":
            df = A.hourly_activity(strikes, now=now, hours=args.hours)
        else:
            df = A.strike_count(strikes)
    return [r.asDict() for r in df.collect()]


def main() -> None:
    for row in run(sys.argv[1:]):
        print(json.dumps(row, default=str))


if __name__ == "__main__":
    main()
