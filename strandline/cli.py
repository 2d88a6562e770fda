"""Command line: init, remember, recall, sync, entity, forget, config.  Results are JSON lines."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULT_STORE = "strandline-store"


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strandline")
    parser.add_argument("--db", default=os.environ.get("STRANDLINE_DB", DEFAULT_STORE))
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="create the store and ask for its owner")
    p = sub.add_parser("remember")
    p.add_argument("text")
    p.add_argument("--source", default="")
    p = sub.add_parser("recall")
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--source")
    p = sub.add_parser("sync")
    p.add_argument("directory")
    p = sub.add_parser("entity")
    p.add_argument("action", choices=["list", "get"])
    p.add_argument("id", nargs="?")
    p.add_argument("--type")
    p.add_argument("--name-like")
    p = sub.add_parser("forget")
    p.add_argument("--entity")
    p.add_argument("--source")
    p = sub.add_parser("config", help="show the owner, or change the given fields")
    p.add_argument("--name")
    p.add_argument("--nickname")
    p.add_argument("--email", action="append", default=[])
    return parser


def print_json(df: DataFrame) -> None:
    for line in df.toJSON().toLocalIterator():
        print(line)


def ask_owner(ask: Callable[[str], str]) -> dict | None:
    """Name, nickname and emails; None without a name.  An empty email ends the list."""

    def answer(prompt: str) -> str:
        try:
            return ask(prompt).strip()
        except EOFError:
            return ""

    name = answer("Your name (empty to skip): ")
    if not name:
        return None
    nickname, emails = answer("Nickname (optional): "), []
    while email := answer("Email (empty to finish): "):
        emails.append(email)
    return {"name": name, "nickname": nickname, "emails": emails}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask: Callable[[str], str] = input) -> int:
    from .operators import entities as E
    from .owner import load_owner, store_owner, update_owner
    from .remote import providers_from
    from .sources.connectors import FilesConnector
    from .sources.store import KnowledgeStore

    args = build_parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    model, embedder = providers_from(os.environ)
    store = KnowledgeStore(spark, args.db, model=model, embedder=embedder)
    if args.command == "init":
        owner = ask_owner(ask)
        if owner:
            store_owner(store, **owner)
    elif args.command == "remember":
        store.remember(args.text, source=args.source)
    elif args.command == "recall":
        print_json(store.recall(args.query, args.limit, source=args.source))
    elif args.command == "sync":
        FilesConnector(args.directory).sync(store)
    elif args.command == "entity":
        if args.action == "get":
            print_json(E.get_entity(store.table("entities"), store.get_entity(args.id)["id"]))
        else:
            print_json(store.find_entities(type=args.type, name_like=args.name_like))
    elif args.command == "forget":
        store.forget(entity_id=args.entity, source=args.source)
    elif args.command == "config":
        changed = args.name or args.nickname is not None or args.email
        print(json.dumps(update_owner(store, args.name, args.nickname, args.email) if changed else load_owner(store)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
