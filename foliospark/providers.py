"""Language-model connectors: a callable prompt -> text, with retries. They run inside tasks, so they must be picklable."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from foliospark.errors import IntelligenceError

TRANSIENT = frozenset({408, 425, 429, 500, 502, 503, 504})


def post(url: str, body: dict, headers: dict[str, str], timeout: float = 120) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        error = IntelligenceError(f"{url} answered {e.code}: {e.read()[:300].decode(errors='replace')}")
        error.transient = e.code in TRANSIENT
        raise error from e
    except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as e:
        error = IntelligenceError(f"{url}: {e}")
        error.transient = True
        raise error from e


@dataclass
class ChatCompletions:
    """Endpoints that take chat-completions requests."""

    url: str
    model: str
    key: str = ""
    temperature: float = 0.1
    max_tokens: int = 1500
    send: Callable = post

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        reply = self.send(f"{self.url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            return reply["choices"][0]["message"]["content"] or ""
        except (KeyError, IndexError, TypeError) as e:
            raise IntelligenceError("the reply has no message") from e


@dataclass
class Messages:
    """Endpoints that take messages requests with a version header."""

    url: str
    model: str
    key: str
    version: str = "2023-06-01"
    temperature: float = 0.1
    max_tokens: int = 1500
    send: Callable = post

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        reply = self.send(f"{self.url.rstrip('/')}/messages", body, {"x-api-key": self.key, "version": self.version})
        parts = reply.get("content") if isinstance(reply, dict) else None
        if not isinstance(parts, list):
            raise IntelligenceError("the reply has no content")
        return "".join(p.get("text", "") for p in parts)


@dataclass
class Retrying:
    """Tries again after transient errors, up to `retries` times, waiting twice as long each time."""

    inner: Callable[[str], str]
    retries: int = 8
    first: float = 1.0
    longest: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, prompt: str) -> str:
        for n in range(self.retries + 1):
            try:
                return self.inner(prompt)
            except IntelligenceError as e:
                if n == self.retries or not getattr(e, "transient", False):
                    raise
                self.sleep(min(self.longest, self.first * 2**n))
        raise AssertionError


def from_settings(url: str | None = None, model: str | None = None, key: str | None = None) -> Callable[[str], str] | None:
    """A connector from arguments, else FOLIO_LLM_URL, FOLIO_LLM_MODEL and FOLIO_LLM_KEY, else None."""
    url, model, key = url or os.environ.get("FOLIO_LLM_URL"), model or os.environ.get("FOLIO_LLM_MODEL"), key or os.environ.get("FOLIO_LLM_KEY", "")
    return Retrying(ChatCompletions(url, model, key)) if url and model else None


def judge_from_settings(url: str | None = None, model: str | None = None, key: str | None = None) -> Callable[[str], str] | None:
    """The model that judges, from arguments, else FOLIO_JUDGE_URL, FOLIO_JUDGE_MODEL and FOLIO_JUDGE_KEY; without a key None: the local judge."""
    url, model, key = url or os.environ.get("FOLIO_JUDGE_URL"), model or os.environ.get("FOLIO_JUDGE_MODEL"), key or os.environ.get("FOLIO_JUDGE_KEY", "")
    return Retrying(ChatCompletions(url, model, key)) if url and model and key else None
