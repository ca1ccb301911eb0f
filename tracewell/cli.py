"""Command line: inventory, search, timeline, validate, apps and appdiff over evidence folders."""

from __future__ import annotations

import argparse
import codecs
import platform
import re
import sys
import time
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, schemas, sink
from .functions import encoding
from .operators import apps, content, inventory, search, snapshot, timeline, validate

#: Fixed value: what is left out of a scan unless told otherwise.
EXCLUDE = ["*/.git/*", "*/node_modules/*"]
#: command -> (option of its result file, prefix of made-up names)
RESULTS = {"inventory": "out", "search": "out_hits", "timeline": "out_timeline", "validate": "out_issues", "apps": "out_apps", "appdiff": "out_diff"}


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("root", help="folder to scan")
    common.add_argument("--out-dir", default="outputs", help="folder of results")
    common.add_argument("--label", default="", help="label in the names of results")
    common.add_argument("--exclude", nargs="*", default=EXCLUDE, help="shell patterns to leave out")
    common.add_argument("--follow-symlinks", action="store_true")
    common.add_argument("--with-hash", action="store_true")
    common.add_argument("--hash-algorithms", nargs="*", default=["md5", "sha256"])
    common.add_argument("--hash-block-size", type=int, default=content.CHUNK)
    common.add_argument("--with-signature", action="store_true")
    common.add_argument("--sig-no-magic", action="store_true", help="accepted; the built-in detection is always used")
    top = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    options = {
        "inventory": [("--out", {"default": ""})],
        "search": [
            ("--out-hits", {"default": ""}),
            ("--kw", {"dest": "keywords", "action": "append", "default": []}),
            ("--regex", {"action": "store_true"}),
            ("--case-sensitive", {"action": "store_true"}),
            ("--include-exts", {"nargs": "*", "default": list(search.EXTENSIONS)}),
            ("--encodings", {"nargs": "*", "default": list(encoding.ENCODINGS)}),
            ("--max-size-mb", {"type": float, "default": 10.0}),
        ],
        "timeline": [("--out-timeline", {"default": ""}), ("--tz-offset-min", {"type": int}), ("--out-inventory", {"default": ""})],
        "validate": [("--out-issues", {"default": ""}), ("--verify-hash", {"action": "store_true"}), ("--baseline", {"default": ""}), ("--out-inventory", {"default": ""})],
        "apps": [("--out-apps", {"default": ""})],
        "appdiff": [("--before", {"required": True}), ("--out-diff", {"default": ""})],
    }
    for name, own in options.items():
        sub = commands.add_parser(name, parents=[common])
        for flag, how in own:
            sub.add_argument(flag, **how)
    return top


def problems(args: argparse.Namespace) -> str | None:
    """What is wrong with the arguments, before anything is scanned."""
    if not Path(args.root).is_dir():
        return f"root is not a folder: {args.root}"
    if Path(args.out_dir).exists() and not Path(args.out_dir).is_dir():
        return f"--out-dir is not a folder: {args.out_dir}"
    try:
        args.hash_algorithms = content.usable_algorithms(args.hash_algorithms)
    except ValueError as e:
        return str(e)
    if args.hash_block_size < 1:
        return "--hash-block-size must be positive"
    if args.command == "search":
        if not args.keywords:
            return "no keyword given"
        try:
            search.compile_all(args.keywords, args.regex, args.case_sensitive)
        except re.error as e:
            return f"broken pattern: {e}"
        if not args.max_size_mb > 0:
            return "--max-size-mb must be positive"
        if not args.encodings:
            return "no encoding given"
        for name in args.encodings:
            try:
                codecs.lookup(name)
            except LookupError:
                return f"unknown encoding: {name}"
    if args.command == "timeline" and args.tz_offset_min is not None and abs(args.tz_offset_min) >= 1440:
        return "--tz-offset-min must be less than a day"
    if args.command == "appdiff" and not Path(args.before).is_dir():
        return f"--before is not a folder: {args.before}"
    if args.command == "validate" and args.baseline and not Path(args.baseline).is_file():
        return f"no such baseline: {args.baseline}"
    return None


def own_outputs(args: argparse.Namespace) -> tuple[list[str], list[str]]:
    """(paths of results inside the root, which a scan leaves out; those of them that a scan record names)."""
    root = Path(args.root).resolve()
    listed = [(Path(args.out_dir), True)]
    for name in (*RESULTS.values(), "out_inventory", "baseline"):
        if value := getattr(args, name, ""):
            listed += [(p, False) for p in (Path(value), sink.meta_path(value), sink.side_path(value, "errors"), sink.side_path(value, "skipped"))]
    inside, recorded = [], []
    for path, folder in listed:
        target = path.resolve()
        if root == target or root.is_relative_to(target):
            if folder:
                print(f"[WARN] the results' folder holds the root, earlier results may be scanned: {path}")
        elif target.is_relative_to(root):
            inside.append(str(target))
            if folder:
                recorded.append(target.relative_to(root).as_posix())
    return inside, recorded


class Run:
    """One command: its inventory, and where results go."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.hidden, self.recorded = own_outputs(args)
        self.now = time.time()

    def build(self, hashed: bool | None = None, signed: bool | None = None) -> tuple[DataFrame, DataFrame]:
        a = self.args
        files, notes = inventory.build(
            self.spark,
            a.root,
            follow_symlinks=a.follow_symlinks,
            exclude=a.exclude,
            exclude_paths=self.hidden,
            algorithms=a.hash_algorithms if (a.with_hash if hashed is None else hashed) else None,
            chunk=a.hash_block_size,
            signature=a.with_signature if signed is None else signed,
        )
        return files.cache(), notes.cache()

    def meta(self, rows: int | None = None) -> dict:
        a = self.args
        return {
            "tool": "tracewell",
            "version": __version__,
            "created_at_utc": datetime.now(UTC).isoformat(timespec="seconds"),
            "command": a.command,
            "root": str(Path(a.root).resolve()),
            "follow_symlinks": a.follow_symlinks,
            "exclude": a.exclude,
            "excluded_paths": self.recorded,
            "hash_algorithms": a.hash_algorithms if a.with_hash else [],
            "with_signature": a.with_signature,
            "platform": platform.platform(),
            "python": platform.python_version(),
            "row_count": rows,
        }

    def target(self) -> Path:
        given = getattr(self.args, RESULTS[self.args.command])
        return Path(given) if given else sink.out_path(self.args.command, sink.ensure_dir(self.args.out_dir), self.args.label)

    def save_inventory(self, files: DataFrame, path: Path) -> None:
        rows = sink.write_csv(files.orderBy("path"), path)
        sink.write_json(self.meta(rows), sink.meta_path(path))
        print(f"[OK] {rows} files -> {path}")

    def report(self, notes: DataFrame, path: Path) -> None:
        if notes.isEmpty():
            return
        counts = {r["kind"]: r["count"] for r in notes.groupBy("kind").count().collect()}
        sink.write_csv(notes.select(*schemas.ERRORS.names).orderBy("path"), sink.side_path(path, "errors"))
        print(f"[WARN] {counts.get(schemas.NOTE_ERROR, 0)} errors, {counts.get(schemas.NOTE_CYCLE, 0)} link cycles -> {sink.side_path(path, 'errors')}")

    def inventory(self) -> None:
        files, notes = self.build()
        path = self.target()
        self.save_inventory(files, path)
        self.report(notes, path)

    def search(self) -> None:
        a = self.args
        files, notes = self.build(False, False)
        hits, skipped = search.search(
            files,
            notes,
            a.keywords,
            regex=a.regex,
            case_sensitive=a.case_sensitive,
            extensions=a.include_exts,
            encodings=a.encodings,
            max_bytes=int(a.max_size_mb * 1024 * 1024),
            follow_symlinks=a.follow_symlinks,
        )
        path = self.target()
        print(f"[OK] {sink.write_csv(hits, path)} hits -> {path}")
        if not skipped.isEmpty():
            print(f"[WARN] {sink.write_csv(skipped, sink.side_path(path, 'skipped'))} files were not searched")

    def timeline(self) -> None:
        a = self.args
        files, notes = self.build()
        offset = a.tz_offset_min
        if offset is None:
            offset = int(datetime.now().astimezone().utcoffset().total_seconds() // 60)
        path = self.target()
        print(f"[OK] {sink.write_csv(timeline.ordered(timeline.timeline(files, self.now, offset)), path)} events -> {path}")
        if a.out_inventory:
            self.save_inventory(files, Path(a.out_inventory))
        self.report(notes, path)

    def validate(self) -> None:
        a = self.args
        a.with_hash = a.with_hash or a.verify_hash or bool(a.baseline)
        files, notes = self.build()
        phases = [
            validate.check_rows(files, self.now, hashed=a.with_hash, follow_symlinks=a.follow_symlinks),
            validate.note_issues(notes),
        ]
        if a.verify_hash:
            phases.append(validate.recheck(files, a.hash_algorithms, chunk=a.hash_block_size))
        if a.baseline:
            told = validate.option_issues(sink.read_meta(a.baseline), self.meta())
            phases.append(self.spark.createDataFrame(told, schemas.ISSUES))
            phases.append(validate.compare(files, a.baseline_rows, a.hash_algorithms, baseline_order="_order"))
        issues = None
        for k, p in enumerate(phases):
            p = p.select(F.lit(k).alias("_phase"), *schemas.ISSUES.names)
            issues = p if issues is None else issues.unionByName(p)
        issues = issues.cache()
        path = self.target()
        count = sink.write_csv(issues.orderBy("_phase", "path", "code", "field"), path, schemas.ISSUES.names)
        print(f"[OK] {count} issues -> {path}")
        print("  " + ", ".join(f"{r['name']}={r['n']}" for r in validate.summary(issues).collect()))
        if a.out_inventory:
            self.save_inventory(files, Path(a.out_inventory))
        self.report(notes, path)

    def apps(self) -> None:
        a = self.args
        files, notes = self.build(signed=True)
        found = apps.apps(files, a.hash_algorithms if a.with_hash else ()).cache()
        path = self.target()
        failed = found.where("status <> 'ok'").count()
        print(f"[OK] {sink.write_csv(found, path)} apps, {failed} of them without facts -> {path}")
        self.report(notes, path)

    def appdiff(self) -> None:
        a = self.args
        changes, notes = snapshot.compare(self.spark, a.before, a.root, a.exclude)
        changes = changes.cache()
        path = self.target()
        print(f"[OK] {sink.write_csv(changes, path)} changes -> {path}")
        print("  " + ", ".join(f"{r['change']}={r['count']}" for r in changes.groupBy("change").count().orderBy("change").collect()))
        self.report(notes, path)


def session() -> SparkSession:
    out = SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    top = parser()
    args = top.parse_args(argv)
    wrong = problems(args)
    if wrong:
        top.error(wrong)
    spark = spark or session()
    if args.command == "validate" and args.baseline:
        try:
            args.baseline_rows = sink.read_inventory(spark, args.baseline)
        except ValueError as e:
            top.error(str(e))
    getattr(Run(spark, args), args.command)()


if __name__ == "__main__":
    main(sys.argv[1:])
