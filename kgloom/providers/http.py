"""A provider over HTTP: any service with a chat interface in JSON."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any

from kgloom.providers.base import ProviderError, Request, Response, Usage

#: Answers that may be different next time.
PASSING = frozenset({408, 409, 425, 429, 500, 502, 503, 504, 529})


class ChatProvider:
    """Posts a request as a system and a user message and reads one JSON object from the answer.

    Time-outs, lost connections and the states in ``PASSING`` are tried again, after waits that double
    and are spread at random; a ``Retry-After`` in seconds is kept. Anything else, and an answer that is
    no JSON object, is an error. ``body`` and ``read`` adapt it to services with other fields. The object is
    made inside a task, so a key given by a function is read on the machine that runs it.
    """

    name = "chat"

    def __init__(
        self, url: str, model: str, headers: dict[str, str] | Callable[[], dict[str, str]] | None = None, timeout: float = 60, tries: int = 5, wait: float = 1,
        body: Callable[[str, Request], dict[str, Any]] | None = None, read: Callable[[dict[str, Any]], tuple[str, int, int]] | None = None,
    ):
        self.url, self.model, self.timeout, self.tries, self.wait = url, model, timeout, tries, wait
        self.headers = headers() if callable(headers) else headers or {}
        self.body, self.read = body or chat_body, read or chat_answer

    def complete(self, request: Request) -> Response:
        data = json.dumps(self.body(self.model, request), ensure_ascii=False).encode()
        asked = urllib.request.Request(self.url, data, {"Content-Type": "application/json", **self.headers})
        for n in range(1, self.tries + 1):
            pause = self.wait * 2 ** (n - 1) * random.uniform(0.5, 1)
            try:
                with urllib.request.urlopen(asked, timeout=self.timeout) as got:
                    text, used_in, used_out = self.read(json.load(got))
                value = json.loads(text.strip().removeprefix("```json").removeprefix("```").removesuffix("```"))
                if not isinstance(value, dict):
                    raise ProviderError("the answer is no JSON object")
                return Response(value, Usage(used_in, used_out))
            except urllib.error.HTTPError as e:
                if e.code not in PASSING or n == self.tries:
                    raise ProviderError(f"state {e.code} after {n} tries") from e
                later = e.headers.get("Retry-After", "")
                pause = max(pause, float(later)) if later.isdigit() else pause
            except (TimeoutError, urllib.error.URLError, ConnectionError) as e:
                if n == self.tries:
                    raise ProviderError(f"no answer after {n} tries: {e}") from e
            except (ValueError, KeyError, IndexError, TypeError) as e:
                raise ProviderError(f"the answer cannot be read: {e}") from e
            time.sleep(pause)
        raise ProviderError("nothing was tried")


def chat_body(model: str, request: Request) -> dict[str, Any]:
    messages = [{"role": "system", "content": request.system}, {"role": "user", "content": request.user}]
    return {"model": model, "messages": messages, "temperature": request.temperature, "max_tokens": request.max_tokens, "response_format": {"type": "json_object"}}


def chat_answer(got: dict[str, Any]) -> tuple[str, int, int]:
    """Text, tokens read and tokens written."""
    used = got.get("usage") or {}
    return got["choices"][0]["message"]["content"], int(used.get("prompt_tokens", 0)), int(used.get("completion_tokens", 0))
