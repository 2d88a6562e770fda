"""Models and embedders behind HTTP interfaces, with a transport that can be replaced.

A transport is ``(url, headers, body) -> answer`` over JSON objects; the default one uses the
standard library.  Nothing here runs unless a provider is configured, and tests inject a
transport, so the library needs no network."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Mapping, Sequence

from .providers import EXTRACTION_PROMPT, OfflineEmbedder, parse_plan

Transport = Callable[[str, dict, dict], dict]

DECOMPOSE_PROMPT = 'Split the question into searches of a knowledge graph. Answer with one JSON object {"queries": [{"type": "keyword" | "memory" | "vector" | "graph", "params": {"query": "..."}}]} and nothing else.'
SUMMARY_PROMPT = "Write one short summary of all the texts. Answer with the summary alone."
SEPARATOR = "\n\n---\n\n"
# Fixed value: the version that the messages interface asks every request to name.
MESSAGES_VERSION = "2023-06-01"


def post_json(url: str, headers: dict, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=120) as answer:
        return json.load(answer)


class _Chat:
    """What both interfaces share: the three requests of a model."""

    def ask(self, system: str, text: str, as_json: bool) -> str:
        raise LookupError("a subclass sends the request")

    def extract(self, text: str, prompt: str = "") -> str:
        return self.ask(prompt or EXTRACTION_PROMPT, text, True)

    def decompose(self, query: str) -> list[dict]:
        return parse_plan(self.ask(DECOMPOSE_PROMPT, query, True))

    def summarize(self, texts: Sequence[str]) -> str:
        return self.ask(SUMMARY_PROMPT, SEPARATOR.join(texts), False)


class CompletionsModel(_Chat):
    """``POST {base}/chat/completions`` with system and user messages."""

    def __init__(self, key: str, base: str, model: str, transport: Transport = post_json):
        self.key, self.base, self.model, self.transport = key, base.rstrip("/"), model, transport

    def ask(self, system: str, text: str, as_json: bool) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}]}
        if as_json:
            body["response_format"] = {"type": "json_object"}
        choices = self.transport(f"{self.base}/chat/completions", {"Authorization": f"Bearer {self.key}"}, body).get("choices") or []
        if not choices:
            raise ValueError("the answer has no choices")
        return choices[0]["message"]["content"]


class MessagesModel(_Chat):
    """``POST {base}/v1/messages``: the system prompt beside the messages, text in content blocks."""

    def __init__(self, key: str, base: str, model: str, max_tokens: int = 4096, transport: Transport = post_json):
        self.key, self.base, self.model, self.max_tokens, self.transport = key, base.rstrip("/"), model, max_tokens, transport

    def ask(self, system: str, text: str, as_json: bool) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": text}]}
        answer = self.transport(f"{self.base}/v1/messages", {"x-api-key": self.key, "anthropic-version": MESSAGES_VERSION}, body)
        return "".join(block["text"] for block in answer.get("content") or [] if block.get("type") == "text")


class RemoteEmbedder:
    """``POST {base}/embeddings`` with a batch of texts."""

    def __init__(self, key: str, base: str, model: str, dimensions: int = 1536, transport: Transport = post_json):
        self.key, self.base, self.model, self.dimensions, self.transport = key, base.rstrip("/"), model, dimensions, transport

    def embed(self, texts: Sequence[str]) -> list[Sequence[float]]:
        rows = self.transport(f"{self.base}/embeddings", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "input": list(texts)})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]


def providers_from(env: Mapping[str, str], transport: Transport = post_json) -> tuple[object | None, object]:
    """(model, embedder) as the environment names them; without a key no model, and the offline embedder.

    STRANDLINE_PROVIDER is ``completions`` (default) or ``messages``; STRANDLINE_KEY, _URL and _MODEL
    belong to it, STRANDLINE_EMBEDDING_KEY, _URL, _MODEL and _DIMS to the embedder (key and url fall
    back to those of a completions model)."""
    get = lambda name: env.get(f"STRANDLINE_{name}", "")
    kind = get("PROVIDER") or "completions"
    if kind not in ("completions", "messages"):
        raise ValueError(f"unknown provider {kind!r}")
    if not get("KEY"):
        if kind == "messages":
            raise ValueError("STRANDLINE_KEY is needed for this provider")
        return None, OfflineEmbedder()
    if not get("URL") or not get("MODEL"):
        raise ValueError("STRANDLINE_URL and STRANDLINE_MODEL are needed with a key")
    model = (CompletionsModel if kind == "completions" else MessagesModel)(get("KEY"), get("URL"), get("MODEL"), transport=transport)
    if not get("EMBEDDING_MODEL"):
        return model, OfflineEmbedder()
    shared = kind == "completions"
    key, url = get("EMBEDDING_KEY") or (get("KEY") if shared else ""), get("EMBEDDING_URL") or (get("URL") if shared else "")
    if not key or not url:
        raise ValueError("STRANDLINE_EMBEDDING_KEY and STRANDLINE_EMBEDDING_URL are needed")
    dims = get("EMBEDDING_DIMS")
    return model, RemoteEmbedder(key, url, get("EMBEDDING_MODEL"), int(dims) if dims.isdigit() else 1536, transport)
