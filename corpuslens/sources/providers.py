"""Classification providers: functions from a prompt to (reply, tokens in, tokens out, error); they never raise."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from corpuslens.operators.classify import OF_DAY, REFUSED

Answer = tuple[str | None, int, int, str | None]


def answer_of(status: int, body: bytes) -> Answer:
    """What an HTTP answer with a list of candidates says; a refusal that names a quota of the day is told apart."""
    if status == 429:
        return None, 0, 0, REFUSED + OF_DAY if b"PerDay" in body else REFUSED
    if status != 200:
        return None, 0, 0, f"http_{status}"
    data = json.loads(body)
    if not data.get("candidates"):
        return None, 0, 0, "no_candidates"
    parts = data["candidates"][0].get("content", {}).get("parts") or [{}]
    usage = data.get("usageMetadata", {})
    return parts[0].get("text", ""), usage.get("promptTokenCount", 0), usage.get("candidatesTokenCount", 0), None


def gemini(endpoint: str, key: str, temperature: float = 0.0, most_tokens: int = 512, timeout: float = 60.0) -> Callable[[str], Answer]:
    """A provider that posts to ``endpoint``.  It is made on the driver and runs where the rows are."""

    def call(prompt: str) -> Answer:
        content = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": temperature, "maxOutputTokens": most_tokens}}
        request = urllib.request.Request(endpoint, json.dumps(content).encode(), {"Content-Type": "application/json", "x-goog-api-key": key})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return answer_of(response.status, response.read())
        except urllib.error.HTTPError as refused:
            return answer_of(refused.code, refused.read())
        except TimeoutError:
            return None, 0, 0, "timeout"
        except Exception as failed:  # a row's failure is its result
            return None, 0, 0, "timeout" if isinstance(getattr(failed, "reason", None), TimeoutError) else str(failed)

    return call


def absent(name: str) -> Callable[..., Callable[[str], Answer]]:
    """A provider whose calls all fail, as it isn't there yet."""
    return lambda *args, **options: lambda prompt: (None, 0, 0, f"{name}_provider_not_yet_implemented")


# The names of providers.
PROVIDERS = {"gemini": gemini, "claude": absent("claude"), "openai": absent("openai")}


def provider(name: str, *args, **options) -> Callable[[str], Answer]:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}")
    return PROVIDERS[name](*args, **options)
