"""Command line: python -m loomtrace.cli -t TRACE -q QUERIES [options]."""

from __future__ import annotations

import argparse
import sys
import time
import traceback

from .errors import DynamicError, QueryError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtrace")
    p.add_argument("-t", "--trace", required=True, help="normalised steps, JSON lines or Parquet")
    p.add_argument("-q", "--queries", required=True)
    p.add_argument("--format", default="json", choices=["json", "parquet"])
    p.add_argument("--model", help="JSON document with uuid, agents and rules; names in queries are held against it")
    p.add_argument("--recycled-ids", action="store_true", help="agents' ids are used again in the trace")
    p.add_argument("--skip-init", action="store_true", help="leave out initial steps")
    p.add_argument("--distributed", action="store_true", help="results as folders of text parts in order, written by the executors")
    p.add_argument("--only", help="names, separated by commas")
    p.add_argument("--output-dir", default=".")
    p.add_argument("--debug-level", type=int, default=1)
    p.add_argument("--profile", action="store_true")
    p.add_argument("--skip-invalid", action="store_true")
    p.add_argument("--snapshots-names", default="snapshots/snapshot.%.json", help="with one %% for the number")
    p.add_argument("--native-snapshots", action="store_true")
    p.add_argument("--no-backtraces", action="store_true")
    for name in ("--no-color", "--no-progress-bars", "--ccs-incremental"):
        p.add_argument(name, action="store_true", help="accepted; has no effect here")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code: 0, 1 for a static error, 2 for a dynamic one, 3 for an internal one."""
    args = parser().parse_args(argv)
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from .plans.engine import TraceEngine
    from .sources import sinks

    spark = spark or SparkSession.builder.appName("loomtrace").getOrCreate()
    engine = None
    try:
        engine = TraceEngine.load(spark, args.trace, args.format, args.model, args.recycled_ids, args.skip_init, snapshots=args.snapshots_names)
        try:
            with open(args.queries) as f:
                text = f.read()
        except FileNotFoundError as e:
            raise QueryError(f"no such file: {args.queries}") from e
        good, errors = engine.compile(text, args.only.split(",") if args.only else None, args.skip_invalid)
        if args.skip_invalid:
            sinks.write_errors(errors, args.output_dir)
        sinks.write_debug(engine, list(good.values()), args.output_dir, args.debug_level)
        for name, c in good.items():
            begin = time.perf_counter()
            if args.profile:  # matching alone, to tell it from what comes after
                engine.matchings(c).write.format("noop").mode("overwrite").save()
                engine.seconds[name, "match"] = time.perf_counter() - begin
                begin = time.perf_counter()
            (sinks.write_text if args.distributed else sinks.write_csv)(engine, c, args.output_dir)
            if any(x.op == "measure" and x.name == "snapshot" for x in _all(c)):
                sinks.write_snapshots(engine, c, args.output_dir, args.native_snapshots)
            engine.seconds[name, "exec-simple" if c.single else "exec"] = time.perf_counter() - begin
        return 1 if errors else 0
    except (QueryError, DynamicError) as e:
        print(f"{e.kind}: {e}", file=sys.stderr)
        return e.exit_code
    except PySparkException as e:
        print(f"Dynamic_error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"Internal_error: {e}", file=sys.stderr)
        if not args.no_backtraces:
            traceback.print_exc()
        return 3
    finally:
        if engine is not None and args.profile:
            sinks.write_profile(engine.seconds, args.output_dir)


def _all(c):
    from .plans.validate import expressions

    return expressions(c.query)


if __name__ == "__main__":
    sys.exit(main())
