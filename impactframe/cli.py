"""Command line: scan, diff, commit and undo a tracked directory, and convert a form export to Markdown."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from impactframe.functions.text import decode_export
from impactframe.operators.forms import render_forms


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="impactframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "diff", "commit", "undo"):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("--baseline")
        s.add_argument("--include", action="append", default=[])
        s.add_argument("--exclude", action="append", default=[])
        if name == "commit":
            s.add_argument("-m", "--message", default="")
    f = sub.add_parser("form")
    f.add_argument("input", type=Path)
    f.add_argument("-o", "--output", type=Path)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code 0 when done, 1 when there was nothing to undo."""
    args = _parser().parse_args(argv)
    if args.command == "form":
        from impactframe.session import local_session

        session = spark or local_session()
        export = session.createDataFrame([(args.input.stem, decode_export(args.input.read_bytes()))], "form string, text string")
        found = render_forms(export).first()
        if found.error:
            raise SystemExit(found.error)
        text = found.markdown
        if args.output:
            args.output.write_text(text, encoding="utf-8")
        else:
            sys.stdout.write(text)
        return 0
    from impactframe.operators.tracker import Tracker
    from impactframe.session import local_session

    tracker = Tracker(spark or local_session(), args.root, args.baseline, args.include, args.exclude)
    if args.command == "commit":
        print(tracker.commit(args.message))
    elif args.command == "undo":
        done = tracker.undo()
        print("undone" if done else "nothing to undo")
        return 0 if done else 1
    else:
        found = tracker.scan()
        if args.command == "diff":
            for row in found.diffs().orderBy("path").toLocalIterator():
                print(row.diff, end="")
        else:
            counts = {r.status: r.n for r in found.changes.groupBy("status").count().withColumnRenamed("count", "n").collect()}
            for row in found.changes.select("status", "path").orderBy("path").toLocalIterator():
                print(row.status, row.path)
            print(", ".join(f"{counts.get(s, 0)} {s}" for s in ("added", "modified", "deleted")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
