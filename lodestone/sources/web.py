"""Pages by URL: every address that a name resolves to must be public, at every hop, and bodies are bounded.

The network is a parameter (``Transport``); ``Internet`` is the real one. It connects to the very address that was judged, so a name can't resolve
to another one in between.
"""

from __future__ import annotations

import http.client
import socket
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.sources.files import address_problem, url_problem

REDIRECTS = (301, 302, 303, 307, 308)
SUFFIXES = {"text/html": ".html", "application/xhtml+xml": ".html", "text/plain": ".txt", "application/pdf": ".pdf"}


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str]  # lower-case names
    body: bytes  # one byte more than the limit at most


class Transport(Protocol):
    def resolve(self, host: str, port: int) -> list[str]: ...

    def get(self, url: str, address: str, limit: int) -> Response: ...


class Internet:
    """HTTP over sockets, pinned to a resolved address."""

    def __init__(self, timeout: float = 20.0):
        self.timeout = timeout

    def resolve(self, host: str, port: int) -> list[str]:
        return sorted({info[4][0] for info in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)})

    def get(self, url: str, address: str, limit: int) -> Response:
        parsed = urlparse(url)
        kind = http.client.HTTPSConnection if parsed.scheme == "https" else http.client.HTTPConnection
        link = kind(parsed.hostname, parsed.port, timeout=self.timeout)
        link._create_connection = lambda to, *rest: socket.create_connection((address, to[1]), *rest)
        try:
            link.request("GET", (parsed.path or "/") + (f"?{parsed.query}" if parsed.query else ""))
            found = link.getresponse()
            return Response(found.status, {k.lower(): v for k, v in found.getheaders()}, found.read(limit + 1))
        finally:
            link.close()


def judged(url: str, transport: Transport) -> str:
    """An address of ``url``'s host; an error if the URL, or any address of the host, is not fit to be fetched."""
    problem = url_problem(url)
    if problem:
        raise ValueError(problem)
    parsed = urlparse(url)
    addresses = transport.resolve(parsed.hostname, parsed.port or (443 if parsed.scheme == "https" else 80))
    if not addresses:
        raise ValueError("the host has no address")
    for address in addresses:
        if address_problem(address):
            raise ValueError("not a public address")
    return addresses[0]


def fetch(url: str, transport: Transport, config: EngineConfig = DEFAULTS) -> tuple[str, bytes, str]:
    """(final URL, body, content type): redirects are followed by hand, each target judged anew."""
    for _ in range(config.workspace_max_redirects + 1):
        found = transport.get(url, judged(url, transport), config.workspace_max_bytes)
        if found.status in REDIRECTS:
            if "location" not in found.headers:
                raise ValueError("a redirect without a target")
            url = urljoin(url, found.headers["location"])
            continue
        if found.status != 200:
            raise ValueError(f"the server answered {found.status}")
        if len(found.body) > config.workspace_max_bytes:
            raise ValueError("the page is too large")
        return url, found.body, found.headers.get("content-type", "").split(";")[0].strip().lower()
    raise ValueError("too many redirects")


def fetched(urls: DataFrame, transport: Transport | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(url, path, content, content_type, problem) of (url) rows, for ``files.extract``; the path's suffix tells the declared type.

    A URL that can't be fetched gives a row with ``problem``; a null URL is one. One page is held at a time.
    """
    net = transport or Internet()
    names = ["url", "path", "content", "content_type", "problem"]
    types = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column("url").to_pylist():
                try:
                    final, body, kind = fetch(url or "", net, config)
                    name = final.rstrip("/").split("/")[-1].split("?")[0] or "page"
                    suffix = SUFFIXES.get(kind, "")
                    row = (url, name if name.lower().endswith(suffix) else name + suffix, body, kind, None)
                except (ValueError, OSError, http.client.HTTPException) as e:
                    row = (url, None, None, None, str(e) or type(e).__name__)
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    return urls.select(F.col("url").cast("string")).mapInArrow(run, "url string, path string, content binary, content_type string, problem string")
