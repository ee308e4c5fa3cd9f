"""Reads a finished session from the command line: python -m graphloom SESSION COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import Session, list_sessions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("session", help="the session's folder; for the command sessions the folder of all")
    s = p.add_subparsers(dest="command", required=True)
    for name, words in {"sessions": (), "stats": (), "types": (), "hubs": (), "orphans": (), "schema": (), "turtle": (), "search": ("query",), "node": ("id",), "note": ("id",), "neighbors": ("id",), "path": ("source", "target"), "context": ("question",), "export": ("folder",), "merge": ("other", "folder")}.items():
        c = s.add_parser(name)
        for w in words:
            c.add_argument(w)
        if name in ("search", "neighbors"):
            c.add_argument("--type")
            c.add_argument("--limit", type=int, default=20)
        if name == "context":
            c.add_argument("--mode", choices=("bfs", "dfs"), default="bfs")
            c.add_argument("--depth", type=int, default=2)
            c.add_argument("--budget", type=int, default=2000)
        if name == "path":
            c.add_argument("--most", type=int, default=5)
    return p


def answer(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The rows that a command shows; None where it only writes."""
    if a.command == "sessions":
        return list_sessions(spark, a.session)
    s = Session(spark, a.session)
    if a.command == "export":
        s.export(a.folder)
        return None
    if a.command == "merge":
        s.merge(Session(spark, a.other)).export(a.folder)
        return None
    calls = {
        "search": lambda: s.search(a.query, a.type, a.limit), "neighbors": lambda: s.neighbors(a.id, "both", a.type, a.limit), "node": lambda: s.node(a.id), "note": lambda: s.note(a.id),
        "path": lambda: s.path_edges(a.source, a.target, a.most).orderBy("hop"), "context": lambda: s.context_text(a.question, a.mode, a.depth, a.budget).orderBy("pos").select("line"),
    }
    return calls[a.command]() if a.command in calls else getattr(s, a.command)()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    rows = answer(spark, a)
    if rows is not None:
        for r in rows.toLocalIterator():
            print("\t".join("" if x is None else str(x) for x in r))


if __name__ == "__main__":
    main()
