"""A fetcher for crawls that reaches public addresses only.

The host of every hop is resolved first; if any of its addresses is reserved nothing is sent, otherwise the first one is
dialled, so that a second resolution can't lead elsewhere.
"""

from __future__ import annotations

import socket
import ssl
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from http.client import HTTPConnection, HTTPException
from urllib.parse import urljoin, urlsplit

from auditloom.functions.urls import reserved

_REDIRECTS = (301, 302, 303, 307, 308)
# --- fixed values: what a crawl asks for ---
HEADERS = {
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.9",
}
# -------------------------------------------


def resolved(host: str, port: int) -> list[str]:
    """Addresses of a host."""
    return [info[4][0] for info in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]


@dataclass(frozen=True)
class GuardedFetcher:
    """Gets a page: (status code, content type, body). OSError where there is no answer, a reserved address, or too many
    redirects. The body is read up to `body_bytes`."""

    agent: str = "auditloom"
    timeout: float = 10.0
    redirects: int = 5
    body_bytes: int = 10 * 1024 * 1024
    resolve: Callable[[str, int], Sequence[str]] = resolved
    blocked: Callable[[str], bool] = reserved

    def __call__(self, url: str) -> tuple[int, str, bytes]:
        for _ in range(self.redirects + 1):
            status, kind, body, target = self._once(url)
            if status not in _REDIRECTS or not target:
                return status, kind, body
            url = urljoin(url, target)
        raise OSError(f"stopped after {self.redirects} redirects")

    def _once(self, url: str) -> tuple[int, str, bytes, str | None]:
        try:
            parts = urlsplit(url)
            secure = {"http": False, "https": True}[parts.scheme.lower()]
            host, port = parts.hostname or "", parts.port or (443 if secure else 80)
        except (KeyError, ValueError):
            raise OSError(f"no web address: {url}") from None
        addresses = self.resolve(host, port)
        for address in addresses:
            if self.blocked(address):
                raise OSError(f"host {host} has the reserved address {address}")
        if not addresses:
            raise OSError(f"host {host} has no address")
        connection = HTTPConnection(host, port, timeout=self.timeout)
        try:
            dialled = socket.create_connection((addresses[0], port), self.timeout)
            connection.sock = ssl.create_default_context().wrap_socket(dialled, server_hostname=host) if secure else dialled
            path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
            connection.request("GET", path, headers={"User-Agent": self.agent, **HEADERS})
            answer = connection.getresponse()
            return answer.status, answer.getheader("Content-Type", ""), answer.read(self.body_bytes), answer.getheader("Location")
        except HTTPException as e:
            raise OSError(f"no HTTP answer: {type(e).__name__}") from e
        finally:
            connection.close()
