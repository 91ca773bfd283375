"""Starting a local embedding server where none listens."""

from __future__ import annotations

import atexit
import shlex
import socket
import subprocess
import time
import urllib.parse
from collections.abc import Callable

from hearthdex.embedding.base import AuthError, EmbedError, Embedder

#: Host names of this machine. Fixed values.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0")
#: Seconds for a connection test, and between tries.
CONNECT, POLL = 2.0, 1.0


def is_local(base: str) -> bool:
    return (urllib.parse.urlsplit(base).hostname or "") in LOCAL_HOSTS


def listens(base: str) -> bool:
    """Whether anything accepts connections there."""
    parts = urllib.parse.urlsplit(base)
    try:
        with socket.create_connection((parts.hostname or "", parts.port or (443 if parts.scheme == "https" else 80)), timeout=CONNECT):
            return True
    except OSError:
        return False


def _end(child: subprocess.Popen) -> None:
    if child.poll() is None:
        child.terminate()
        try:
            child.wait(5)
        except subprocess.TimeoutExpired:
            child.kill()


def connect_or_start(connect: Callable[[], Embedder], base: str, command: str | None, timeout: float = 600.0, poll: float = POLL) -> tuple[Embedder, subprocess.Popen | None]:
    """The embedder, from a server that runs or else from one started with ``command``, on the driver.

    Nothing is started if the first try fails for another reason than that nothing
    listens, if the address isn't this machine, or without a command. Waiting ends early
    when the server rejects the credentials or exits. A started server ends with the driver.
    """
    try:
        return connect(), None
    except EmbedError:
        if not command or not is_local(base) or listens(base):
            raise
    child = subprocess.Popen(shlex.split(command), stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    atexit.register(_end, child)
    until = time.monotonic() + timeout
    while True:
        try:
            return connect(), child
        except AuthError:
            _end(child)
            raise
        except EmbedError as x:
            if child.poll() is not None:
                raise EmbedError(f"the embedding server ended with {child.returncode}: {x}") from None
            if time.monotonic() >= until:
                _end(child)
                raise EmbedError(f"the embedding server was not ready within {timeout:g} s: {x}") from None
            time.sleep(poll)
