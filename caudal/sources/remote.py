"""Remote sources as interfaces: the transport is passed in, retries and file handling are here."""

from __future__ import annotations

import ftplib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import manifest


class NotFound(Exception):
    """The transport says that the object does not exist."""


def with_retries(call: Callable[[], bytes], retries: int = 3, wait: float = 1.0, allow_missing: bool = False, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The result of ``call``; None for a missing object if that is allowed. Other errors are tried again, then raised."""
    for attempt in range(retries + 1):
        try:
            return call()
        except NotFound:
            if allow_missing:
                return None
            raise
        except Exception:
            if attempt == retries:
                raise
            sleep(wait * (attempt + 1))
    return None


def fetch_json(get: Callable[[str], bytes], url: str, **retry) -> dict | list | None:
    body = with_retries(lambda: get(url), **retry)
    return None if body is None else json.loads(body)


def listing(spark: SparkSession, entries: Iterable[tuple[str, int]], names: manifest.Names = manifest.INPATIENT) -> DataFrame:
    """(name, size, uf, year, month) of a remote folder's entries, with part where names have one."""
    return manifest.parse_names(spark.createDataFrame(list(entries), "name string, size long"), names)


def http_get(url: str, timeout: float = 60.0) -> bytes:
    """A transport over HTTP for ``fetch_json``."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise NotFound(url) from e
        raise


class Ftp:
    """A folder of an FTP server as entries for ``listing`` and as the ``retrieve`` of ``download``."""

    def __init__(self, host: str, folder: str, timeout: float = 60.0, connect: Callable[..., ftplib.FTP] = ftplib.FTP) -> None:
        self.host, self.folder, self.timeout, self.connect = host, folder, timeout, connect

    def _open(self) -> ftplib.FTP:
        ftp = self.connect(self.host, timeout=self.timeout)
        ftp.login()
        ftp.cwd(self.folder)
        ftp.voidcmd("TYPE I")
        return ftp

    def entries(self) -> list[tuple[str, int]]:
        """(name, size) from the server's listing: dates, times, size and name a line."""
        lines: list[str] = []
        ftp = self._open()
        try:
            ftp.retrlines("LIST", lines.append)
        finally:
            ftp.close()
        out = []
        for line in lines:
            parts = line.split(maxsplit=3) if line[:1].isdigit() else line.split(maxsplit=8)
            size, name = (parts[2], parts[3]) if len(parts) == 4 else (parts[4], parts[8]) if len(parts) == 9 else ("", "")
            if size.isdigit():
                out.append((name.strip(), int(size)))
        return out

    def retrieve(self, name: str, offset: int) -> Iterable[bytes]:
        ftp = self._open()
        try:
            with ftp.transfercmd(f"RETR {name}", rest=offset or None) as data:
                while chunk := data.recv(1 << 20):
                    yield chunk
        finally:
            ftp.close()


@dataclass
class Downloads:
    downloaded: int = 0
    skipped: int = 0
    failures: list[str] = field(default_factory=list)


def download(names: Iterable[tuple[str, int]], folder: str, retrieve: Callable[[str, int], Iterable[bytes]], retries: int = 3, wait: float = 1.0, verify: bool = True, sleep: Callable[[float], None] = time.sleep) -> Downloads:
    """Fetches what isn't there in full yet. ``retrieve(name, offset)`` gives chunks from an offset, so a broken file is resumed.

    A file gets its name only once it is whole; until then it ends in ``.part``.
    """
    os.makedirs(folder, exist_ok=True)
    out = Downloads()
    for name, size in names:
        whole, part = os.path.join(folder, name), os.path.join(folder, f"{name}.part")
        if os.path.exists(whole) and (not verify or os.path.getsize(whole) == size):
            out.skipped += 1
            continue

        def attempt() -> bytes:
            offset = os.path.getsize(part) if os.path.exists(part) else 0
            with open(part, "ab") as f:
                for chunk in retrieve(name, offset):
                    f.write(chunk)
            if verify and os.path.getsize(part) != size:
                if os.path.getsize(part) > size:
                    os.remove(part)
                raise OSError(f"{name} has the wrong size")
            os.replace(part, whole)
            return b""

        try:
            with_retries(attempt, retries, wait, sleep=sleep)
            out.downloaded += 1
        except Exception as e:
            out.failures.append(f"{name}: {e}")
    return out
