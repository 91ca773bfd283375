"""An HTTP endpoint for embeddings: what its answers mean, and calling it."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

from hearthdex.embedding.base import AuthError, ContextExceeded, EmbedError, Embedder, EmbedTimeout, TransientError, l2_normalize

#: The type of an error body that reports an overflow. A fixed value.
OVERFLOW_TYPE = "exceed_context_size_error"

_ERROR = "error struct<type:string, n_prompt_tokens:bigint, n_ctx:bigint>"
_PROPS = "default_generation_settings struct<n_ctx:bigint>, total_slots bigint"
_MODELS = "data array<struct<id:string, aliases:array<string>, meta:struct<n_ctx:bigint>>>"


def classify(status: Column, body: Column) -> Column:
    """overflow, auth, transient, embed or ok of an answer. An overflow counts whatever the status."""
    error = F.from_json(body, _ERROR)["error"]
    return (
        F.when(F.coalesce((error["type"] == OVERFLOW_TYPE) & (error["n_ctx"] > 0), F.lit(False)) & ~status.between(200, 299), "overflow")
        .when(status.between(200, 299), "ok")
        .when(status.isin(401, 403), "auth")
        .when((status == 429) | status.between(500, 599), "transient")
        .otherwise("embed")
    )


def retryable(kind: Column) -> Column:
    return kind.isin("transient", "timeout")


def props_caps(body: Column) -> tuple[Column, Column]:
    """Window and slots of a properties answer; 0, missing or no JSON is null."""
    props = F.from_json(body, _PROPS)
    return F.nullif(props["default_generation_settings"]["n_ctx"], F.lit(0).cast("long")), F.nullif(props["total_slots"], F.lit(0).cast("long"))


def model_caps(body: Column, model: str) -> Column:
    """Window of the listed model of that id or alias."""
    data = F.from_json(body, _MODELS)["data"]
    mine = F.filter(data, lambda m: (m["id"] == model) | F.coalesce(F.array_contains(m["aliases"], model), F.lit(False)))
    return F.nullif(F.get(mine, 0)["meta"]["n_ctx"], F.lit(0).cast("long"))


@dataclass(frozen=True)
class Caps:
    max_input_tokens: int | None = None
    total_slots: int | None = None
    source: str = "none"

    def or_else(self, other: Caps) -> Caps:
        """Field by field; the source follows the window."""
        source = self.source if self.max_input_tokens else other.source if other.max_input_tokens else self.source
        return Caps(self.max_input_tokens or other.max_input_tokens, self.total_slots or other.total_slots, source)


def _positive(x: object) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and x > 0 else None


def parse_props(body: str) -> Caps:
    try:
        data = json.loads(body)
    except ValueError:
        return Caps()
    if not isinstance(data, dict):
        return Caps()
    settings = data.get("default_generation_settings")
    window = _positive(settings.get("n_ctx")) if isinstance(settings, dict) else None
    return Caps(window, _positive(data.get("total_slots")), "props" if window else "none")


def parse_models(body: str, model: str) -> Caps:
    try:
        data = json.loads(body)
    except ValueError:
        return Caps()
    for m in data.get("data", []) if isinstance(data, dict) else []:
        if isinstance(m, dict) and (m.get("id") == model or model in (m.get("aliases") or [])):
            window = _positive((m.get("meta") or {}).get("n_ctx"))
            return Caps(window, None, "models" if window else "none")
    return Caps()


def probe_url(base: str, model: str) -> str | None:
    """Properties of one model; None where the base is no address."""
    parts = urllib.parse.urlsplit(base)
    if not parts.scheme or not parts.netloc:
        return None
    return f"{parts.scheme}://{parts.netloc}{parts.path.rstrip('/')}/props?" + urllib.parse.urlencode({"model": model})


def error_of(status: int, url: str, body: str) -> EmbedError:
    """The error that an answer stands for; the body is quoted up to 300 characters."""
    body = body.strip()
    detail = f": {body[:300]}{'…' if len(body) > 300 else ''}" if body else ""
    try:
        error = json.loads(body).get("error", {})
        if error.get("type") == OVERFLOW_TYPE and error.get("n_ctx", 0) > 0:
            return ContextExceeded(int(error.get("n_prompt_tokens", 0)), int(error["n_ctx"]))
    except (ValueError, AttributeError, TypeError):
        pass
    if status in (401, 403):
        return AuthError(f"POST {url} rejected with {status}{detail}. The endpoint wants authentication: set [embedder] api_key to a valid key.")
    if status == 429 or 500 <= status < 600:
        return TransientError(f"POST {url} failed with {status}{detail}")
    return EmbedError(f"POST {url} failed with {status}{detail}")


class HttpEmbedder(Embedder):
    """``POST {base}/v1/embeddings``; finds its dimension and limits when made, on the driver."""

    def __init__(self, base: str, model: str, api_key: str | None = None, timeout: float = 30.0, probe: bool = True):
        self.base, self.model, self.api_key, self.timeout = base.rstrip("/"), model, api_key, max(timeout, 1.0)
        self._dim = 1
        if probe:
            self._dim = max(self.embed(["probe"]).shape[1], 1)
            caps = self.probe()
            self.max_input_tokens, self.max_concurrent_requests, self.caps_source = caps.max_input_tokens, caps.total_slots, caps.source

    @property
    def id(self) -> str:
        return self.model

    @property
    def dim(self) -> int:
        return self._dim

    def _get(self, url: str) -> str:
        request = urllib.request.Request(url, headers=self._headers())
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except (OSError, ValueError):
            return ""

    def _headers(self) -> dict[str, str]:
        return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})

    def probe(self) -> Caps:
        """The model's properties, then the server's, then the list of models, as long as something is unknown."""
        caps = Caps()
        one = probe_url(self.base, self.model)
        for url in ([one] if one else []) + [f"{self.base}/props"]:
            if not (caps.max_input_tokens and caps.total_slots):
                caps = caps.or_else(parse_props(self._get(url)))
        if not caps.max_input_tokens:
            caps = caps.or_else(parse_models(self._get(f"{self.base}/v1/models"), self.model))
        return caps

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self._dim), dtype=np.float32)
        url = f"{self.base}/v1/embeddings"
        body = json.dumps({"model": self.model, "input": texts}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, self._headers()), timeout=self.timeout) as answer:
                raw = answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as x:
            raise error_of(x.code, url, x.read().decode("utf-8", "replace")) from None
        except TimeoutError as x:
            raise EmbedTimeout(str(x)) from None
        except OSError as x:
            raise TransientError(f"POST {url}: {x}") from None
        try:
            rows = [item["embedding"] for item in json.loads(raw)["data"]]
        except (ValueError, KeyError, TypeError) as x:
            raise EmbedError(f"bad answer from {url}: {x}") from None
        if len(rows) != len(texts):
            raise EmbedError(f"{len(rows)} vectors for {len(texts)} texts")
        return l2_normalize(np.array(rows, dtype=np.float32))
