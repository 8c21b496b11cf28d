"""Chat endpoints of language models as the callable (prompt -> answer) that ``model_claims`` and ``user_claims`` take.

A route is one endpoint that speaks the common chat protocol. Several routes form a chain: the next one is asked when one fails. Routes come
from settings, which come from the environment and from files of ``KEY=VALUE`` lines; the environment goes first.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from rollweave.sources.files import log

#: What a model is told before the prompt.
INSTRUCTION = "Answer with valid JSON and nothing else. Leave out what the document does not say."

Post = Callable[[str, dict[str, str], bytes, float], tuple[int, str]]


class ChatRoute(NamedTuple):
    url: str  # the whole address of the chat endpoint
    model: str
    token: str = ""
    timeout: float = 90.0


def http_post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, str]:
    """Status and text of the answer, whatever the status."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def _said(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def error_text(status: int, text: str) -> str:
    """What an endpoint says went wrong: the message in its JSON, else its text."""
    got = _said(text)
    error = got.get("error") if isinstance(got, dict) else None
    message = (error.get("message") or json.dumps(error)) if isinstance(error, dict) else error
    return f"model endpoint, status {status}: {message or text.strip()}"


def chat(route: ChatRoute, prompt: str, post: Post = http_post) -> str:
    """Answer of one route; RuntimeError for any status but success and for an answer of another shape."""
    headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {route.token}"} if route.token else {})}
    body = {"model": route.model, "messages": [{"role": "system", "content": INSTRUCTION}, {"role": "user", "content": prompt}], "temperature": 0, "stream": False}
    status, text = post(route.url, headers, json.dumps(body).encode(), route.timeout)
    if not 200 <= status < 300:
        raise RuntimeError(error_text(status, text))
    try:
        return str(_said(text)["choices"][0]["message"].get("content") or "")
    except (TypeError, KeyError, IndexError, AttributeError):
        raise RuntimeError("model endpoint: an answer without a choice") from None


def chain(routes: list[ChatRoute], post: Post = http_post) -> Callable[[str], str]:
    """A model that asks the routes in turn until one answers; the last failure is the caller's. Without routes every call fails."""

    def model(prompt: str) -> str:
        failed: Exception = RuntimeError("no route to a model is set")
        for r in routes:
            try:
                return chat(r, prompt, post)
            except (OSError, RuntimeError) as e:
                log.warning("%s: %s", r.model, e)
                failed = e
        raise failed

    return model


def read_settings(paths: list[str], environment: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Settings of the environment, then of the files that exist, in order; what is set already stays. Blank lines, comments and lines without ``=`` are skipped, quotes around values too."""
    out = dict(environment)
    for path in paths:
        if os.path.isfile(path):
            with open(path, encoding="utf-8-sig") as f:
                for line in f:
                    key, eq, value = line.strip().partition("=")
                    if eq and key.strip() and not key.startswith("#"):
                        out.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return out


def routes_of(settings: Mapping[str, str], prefix: str = "MODEL") -> list[ChatRoute]:
    """Routes of the settings ``MODEL_URL``, ``MODEL_NAME``, ``MODEL_TOKEN`` and ``MODEL_TIMEOUT``, then ``MODEL2_URL`` and so on as far as they go."""
    out = []
    for n in range(1, 100):
        p = f"{prefix}{n if n > 1 else ''}"
        if not settings.get(f"{p}_URL"):
            break
        out.append(ChatRoute(settings[f"{p}_URL"], settings.get(f"{p}_NAME", ""), settings.get(f"{p}_TOKEN", ""), float(settings.get(f"{p}_TIMEOUT") or 90)))
    return out
