"""Requests, responses and the protocol that every provider follows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any, Protocol


class ProviderError(RuntimeError):
    """A provider could not answer."""


@dataclass(frozen=True)
class Usage:
    input_tokens: int = 0
    output_tokens: int = 0


@dataclass(frozen=True)
class Request:
    """What is asked: a task, its system text, its user text and the payload it was rendered from."""

    task: str
    system: str
    user: str
    payload: dict[str, Any] = field(default_factory=dict)
    temperature: float = 0.0
    max_tokens: int = 4096

    def key(self) -> str:
        """Identifies the request in a replay table."""
        return hashlib.sha256(json.dumps([self.task, self.system, self.user], ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Response:
    value: dict[str, Any]
    usage: Usage = Usage()


class Provider(Protocol):
    """Answers one request with a JSON-like value. Objects are made inside the task that uses them."""

    name: str

    def complete(self, request: Request) -> Response: ...
