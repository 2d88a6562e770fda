"""The owner's identity: kept in the store as a person entity and a summary sentence."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions.text import canonical_json
from .operators.ingest import entity_id

SOURCE = "owner"


def summary(name: str, nickname: str = "", emails: list[str] | None = None) -> str:
    # The wording of the stored summary.
    parts = [f"My name is {name}."]
    if nickname:
        parts.append(f"My nickname is {nickname}.")
    if emails:
        parts.append(f"My email addresses are {', '.join(emails)}.")
    return " ".join(parts)


def add_email(emails: list[str], email: str) -> list[str]:
    """With ``email`` unless it is there already, whatever its case."""
    return emails if email.lower() in (e.lower() for e in emails) else [*emails, email]


def store_owner(store, name: str, nickname: str = "", emails: list[str] | None = None) -> None:
    """Replace what was known of the owner."""
    store.forget(source=SOURCE, strict_source=True)
    pairs = {"nickname": nickname, "emails": ", ".join(emails or [])}
    attributes = canonical_json(F.create_map(*[F.lit(x) for k, v in pairs.items() if v for x in (k, v)])) if any(pairs.values()) else F.lit("{}")
    row = store.spark.range(1).select(entity_id(F.lit("person"), F.lit(name)).alias("id"), F.lit("person").alias("type"), F.lit(name).alias("name"), attributes.alias("attributes"), F.lit(SOURCE).alias("source"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    store.put_entities(row)
    store.remember(summary(name, nickname, emails), source=SOURCE)


def load_owner(store) -> dict | None:
    """The stored owner as name, nickname and emails; None before one was set."""
    row = store.find_entities(type="person", source=SOURCE).orderBy("created_at", "id").first()
    if row is None:
        return None
    kept = json.loads(row["attributes"] or "{}")
    return {"name": row["name"], "nickname": kept.get("nickname", ""), "emails": [e for e in (x.strip() for x in kept.get("emails", "").split(",")) if e]}


def update_owner(store, name: str | None = None, nickname: str | None = None, emails: list[str] | None = None) -> dict:
    """The stored owner with the given fields in place of its own and the emails added."""
    now = load_owner(store) or {"name": "", "nickname": "", "emails": []}
    now["name"], now["nickname"] = name or now["name"], now["nickname"] if nickname is None else nickname
    for email in emails or []:
        now["emails"] = add_email(now["emails"], email)
    if not now["name"]:
        raise ValueError("the owner needs a name")
    store_owner(store, **now)
    return now
