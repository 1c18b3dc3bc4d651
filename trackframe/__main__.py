"""python -m trackframe {demo,analyse,index,search,stats,export,config}"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from trackframe.operators.search import VectorIndex
from trackframe.plans import config as settings
from trackframe.plans import match
from trackframe.session import session
from trackframe.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trackframe")
    sub = p.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("demo", help="a synthetic track through the whole pipeline")
    demo.add_argument("--out")
    analyse = sub.add_parser("analyse", help="persons (Parquet) to a clip database")
    analyse.add_argument("persons")
    analyse.add_argument("out")
    analyse.add_argument("--config")
    analyse.add_argument("--dry-run", action="store_true")
    index = sub.add_parser("index", help="index vectors (Parquet)")
    for name in ("vectors", "out"):
        index.add_argument(name)
    find = sub.add_parser("search", help="nearest vectors of an index")
    find.add_argument("index")
    find.add_argument("query", help="a JSON array")
    find.add_argument("-k", type=int, default=10)
    for q in (index, find):
        q.add_argument("--key", default="clip_id")
        q.add_argument("--vector", default="embedding")
    stats = sub.add_parser("stats", help="statistics of a clip table (Parquet)")
    stats.add_argument("clips")
    export = sub.add_parser("export", help="clips and frames (Parquet) to files")
    for name in ("clips", "frames", "out"):
        export.add_argument(name)
    shown = sub.add_parser("config", help="print the settings, or check a file")
    shown.add_argument("file", nargs="?")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "config":
        made = settings.load(args.file) if args.file else settings.Config()
        print(settings.dump(made) if made else f"{args.file} is no settings file")
        return int(made is None)
    spark = session()
    if args.command == "demo":
        smooth, found, ranges = match.build(readers.demo(spark), settings.Config(cluster=settings.ClusterConfig(enabled=False)))
        found.orderBy("start_frame").show(truncate=False)
        if args.out:
            db = match.database(smooth, ranges, settings.Config(cluster=settings.ClusterConfig(enabled=False)))
            print(db.export(args.out))
    elif args.command == "analyse":
        config = settings.load(args.config) if args.config else settings.Config()
        if config is None:
            print(f"{args.config} is no settings file")
            return 2
        if args.dry_run:
            print(settings.dump(config))
            return 0
        db = match.analyse(spark.read.parquet(args.persons), config)
        db.clips.write.mode("overwrite").parquet(f"{args.out}/clips")
        db.frames.write.mode("overwrite").parquet(f"{args.out}/frames")
        print(db.summary().first()["json"])
    elif args.command == "index":
        VectorIndex.build(spark.read.parquet(args.vectors), args.key, args.vector).save(args.out)
    elif args.command == "search":
        VectorIndex.load(spark, args.index, args.key, args.vector).search(json.loads(args.query), args.k).drop(args.vector).show(truncate=False)
    elif args.command == "stats":
        print(writers.summary(spark.read.parquet(args.clips)).first()["json"])
    elif args.command == "export":
        frames = spark.read.parquet(args.frames).withColumn("clip_id", F.col("clip_id"))
        print(writers.export_database(spark.read.parquet(args.clips), frames, args.out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
