"""Command line of a store: backup, restore, upgrade, trace and statistics."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.config import StoreConfig, apply_overrides, parse_config
from granary.sources.files import read_directory, read_file_list, write_trace
from granary.sources.store import Store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="granary")
    p.add_argument("path", nargs="?", help="folder to back up, or to restore into")
    p.add_argument("-c", "--config", help="file of directives")
    p.add_argument("-p", "--set", help="directives, parted by a comma and a space")
    p.add_argument("-s", "--stats", action="store_true")
    p.add_argument("-t", "--trace", action="store_true", help="write a text trace of the folder")
    p.add_argument("-l", "--list", action="store_true", help="the path is a list of files")
    p.add_argument("-r", "--restore", type=int, metavar="VERSION")
    p.add_argument("-u", "--upgrade", metavar="TARGET", help="folder of the upgraded store")
    args = p.parse_args(argv)
    config = StoreConfig()
    if args.config:
        with open(args.config) as f:
            config = parse_config(f.read())
    if args.set:
        config = apply_overrides(config, args.set)
    spark = SparkSession.builder.appName("granary").getOrCreate()
    store = Store(spark, config.working_directory, config)
    if args.stats:
        store.stats().show(truncate=False)
    elif args.upgrade:
        store.upgrade(args.upgrade)
    elif args.restore is not None:
        store.restore(args.restore).write.mode("overwrite").parquet(args.path)
    elif args.path and args.trace:
        files = read_file_list(spark, args.path) if args.list else read_directory(spark, args.path)
        write_trace(store._chunks(files).select("file_id", "file_name", "chunk_no", "fp", F.col("size")), f"{config.working_directory}/trace")
    elif args.path:
        print(store.backup(read_file_list(spark, args.path) if args.list else read_directory(spark, args.path)))
    else:
        p.print_help()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
