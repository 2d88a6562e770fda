"""The store's operations by the names under which a tool or web server would offer them.

Each takes the store and keyword parameters and returns DataFrames, rows or nothing; a server
only has to turn those into JSON."""

from __future__ import annotations

from collections.abc import Callable

DEFAULT_SEARCH_LIMIT = 10


def search(store, query: str, mode: str = "keyword", limit: int = DEFAULT_SEARCH_LIMIT):
    ways = {"keyword": store.search_keyword, "vector": store.search_vector, "memory": store.search_memories}
    if mode not in ways:
        raise ValueError(f"unknown search {mode!r}")
    return ways[mode](query, limit)


OPERATIONS: dict[str, Callable] = {
    "remember": lambda store, content, source=None: store.remember(content, source=source),
    "recall": lambda store, query, limit=20, source=None: store.recall(query, limit, source=source),
    "forget": lambda store, entity_id=None, source=None: store.forget(entity_id, source),
    "get_entity": lambda store, id: store.get_entity(id),
    "find_entities": lambda store, type=None, name=None, source=None: store.find_entities(type=type, name_like=name, source=source),
    "get_relationships": lambda store, entity_id, types=None: store.get_relationships(entity_id, types),
    "traverse": lambda store, start_id, depth=1, types=None: store.traverse(start_id, depth, types),
    "search": search,
}


def call(store, operation: str, /, **params):
    if operation not in OPERATIONS:
        raise LookupError(f"no operation {operation!r}")
    return OPERATIONS[operation](store, **params)
