"""Embedders: the contract, deterministic doubles and faults."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod

import numpy as np


class EmbedError(Exception):
    """A rejected input; neither worth a retry nor fatal for the run."""

    kind = "embed"
    retryable = False
    fatal = False


class AuthError(EmbedError):
    """The endpoint wants other credentials; every input would fail alike."""

    kind, fatal = "auth", True


class TransientError(EmbedError):
    """Overload, reset or rate limit; the same request may succeed later."""

    kind, retryable = "transient", True


class EmbedTimeout(EmbedError):
    kind, retryable = "timeout", True


class ContextExceeded(EmbedError):
    """An input is longer than the endpoint's window; carries the endpoint's numbers."""

    kind = "overflow"

    def __init__(self, n_prompt: int, n_ctx: int):
        super().__init__(f"embedding input too large: {n_prompt} tokens exceeds the endpoint's {n_ctx}-token context window")
        self.n_prompt, self.n_ctx = n_prompt, n_ctx

    def __reduce__(self):
        return ContextExceeded, (self.n_prompt, self.n_ctx)


class Embedder(ABC):
    """Must be picklable: workers get a copy and connect when first used."""

    max_input_tokens: int | None = None
    max_concurrent_requests: int | None = None
    caps_source: str = "none"

    @property
    @abstractmethod
    def id(self) -> str: ...

    @property
    @abstractmethod
    def dim(self) -> int: ...

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """A float32 row of unit length (or zeros) per text; raises EmbedError."""


def l2_normalize(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(size > 0, rows / np.where(size > 0, size, 1), rows).astype(np.float32)


def byte_sums(text: str, dim: int) -> np.ndarray:
    """Slot i mod dim gains (byte + 1) times (i mod 7 + 1) for each byte i."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.float64)
    at = np.arange(len(raw))
    return np.bincount(at % dim, weights=(raw + 1) * (at % 7 + 1), minlength=dim)[:dim] if len(raw) else np.zeros(dim)


class MockEmbedder(Embedder):
    """Deterministic and offline; near in bytes, not in meaning.

    ``fail_first`` calls raise a transient error, ``always`` raises that kind of error each
    time, ``limit`` is a window in tokens at ``bytes_per_token`` (rounded up). Calls are
    counted in a file, as attributes don't come back from workers.
    """

    def __init__(
        self, dim: int = 8, fail_first: int = 0, always: str | None = None, limit: int | None = None, bytes_per_token: float = 4.0,
        poison: str | None = None, slots: int | None = None, count_in: str | None = None,
    ):
        self._dim, self.fail_first, self.always, self.limit, self.bytes_per_token, self.poison = dim, fail_first, always, limit, bytes_per_token, poison
        self.max_input_tokens, self.max_concurrent_requests = None, slots
        self.count_in = count_in
        if fail_first and not count_in:
            raise ValueError("fail_first needs count_in")

    @property
    def id(self) -> str:
        return f"mock-{self._dim}"

    @property
    def dim(self) -> int:
        return self._dim

    def calls(self) -> int:
        return os.path.getsize(self.count_in) if self.count_in and os.path.exists(self.count_in) else 0

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.count_in:
            with open(self.count_in, "ab") as f:
                f.write(b".")
        if self.always == "auth":
            raise AuthError("rejected")
        if self.always == "transient" or (self.fail_first and self.calls() <= self.fail_first):
            raise TransientError("overloaded")
        if self.always == "embed" or (self.poison and any(self.poison in t for t in texts)):
            raise EmbedError("rejected input")
        if self.limit is not None:
            most = max((-(-len(t.encode()) // self.bytes_per_token) for t in texts), default=0)
            if most > self.limit:
                raise ContextExceeded(int(most), self.limit)
        return l2_normalize(np.array([byte_sums(t, self._dim) for t in texts]).reshape(len(texts), self._dim))
