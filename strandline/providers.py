"""What can be plugged in: models, embedders, extractors.  The defaults work offline."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Protocol

from .functions import vectors


class Model(Protocol):
    def extract(self, text: str, prompt: str) -> str: ...
    def decompose(self, query: str) -> list[dict]: ...
    def summarize(self, texts: Sequence[str]) -> str: ...


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[Sequence[float]]: ...


class Extractor(Protocol):
    def extract(self, text: str, content_type: str) -> dict:
        """``entities``, ``relationships`` and ``memories`` in the JSON shape of a model's answer."""


class Connector(Protocol):
    def sync(self, store) -> None: ...


class OfflineEmbedder:
    dimensions = vectors.DIMENSIONS

    def embed(self, texts: Sequence[str]) -> list[Sequence[float]]:
        return [vectors.embed_text(t) for t in texts]


class ScriptedModel:
    """Answers from tables given in advance; for tests and offline use."""

    def __init__(self, answers: dict[str, str] | None = None, plans: dict[str, list[dict]] | None = None):
        self.answers, self.plans = answers or {}, plans or {}

    def extract(self, text: str, prompt: str = "") -> str:
        return self.answers.get(text, '{"entities": [], "relationships": [], "memories": []}')

    def decompose(self, query: str) -> list[dict]:
        return self.plans.get(query, [])

    def summarize(self, texts: Sequence[str]) -> str:
        return " ".join(texts)


def parse_plan(raw: str) -> list[dict]:
    """The sub-queries of a model's ``{"queries": [{"type", "params"}]}``; no code fence is stripped."""
    return [{"type": q.get("type", ""), "params": q.get("params") or {}} for q in json.loads(raw).get("queries") or []]


EXTRACTION_PROMPT = "List the entities (type, name), relationships (source, target, type) and memories (content) of the text as one JSON object."
