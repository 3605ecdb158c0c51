"""Opening of inputs: local or remote paths, http, globs, gzip found by its first bytes."""

from __future__ import annotations

import gzip
import io
import os
import urllib.error
import urllib.request
import uuid
from glob import glob
from typing import BinaryIO

from pyarrow import fs


def expand(path: str) -> list[str]:
    """The files of comma-separated paths, globs and folders; a missing one is an error."""
    found: list[str] = []
    for part in filter(None, path.split(",")):
        if part.startswith(WEB):
            found.append(part)
            continue
        if "://" in part and not part.startswith("file:"):
            system, inner = fs.FileSystem.from_uri(part)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                listed = system.get_file_info(fs.FileSelector(inner))
                scheme = part.split("://")[0]
                found += sorted(f"{scheme}://{x.path}" for x in listed if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
                continue
            if info.type != fs.FileType.File:
                raise FileNotFoundError(part)
            found.append(part)
            continue
        local = part.removeprefix("file://").removeprefix("file:")
        names = sorted(glob(f"{local.rstrip('/')}/*")) or sorted(glob(local))
        names = [n for n in names if not n.rsplit("/", 1)[-1].startswith(("_", ".")) and not n.endswith((".bai", ".fai"))]
        if not names:
            raise FileNotFoundError(part)
        found += names
    return found


def _local(path: str) -> str | None:
    return None if "://" in path and not path.startswith("file:") else path.removeprefix("file://").removeprefix("file:")


def exists(path: str) -> bool:
    if path.startswith(WEB):
        try:
            with urllib.request.urlopen(urllib.request.Request(path, method="HEAD")):
                return True
        except urllib.error.HTTPError:
            return False
    if (name := _local(path)) is not None:
        return os.path.exists(name)
    system, inner = fs.FileSystem.from_uri(path)
    return system.get_file_info(inner).type == fs.FileType.File


def open_write(path: str) -> BinaryIO:
    """A new file, its folder made where it is missing."""
    if (name := _local(path)) is not None:
        os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
        return open(name, "wb")
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def moved(old: str, new: str) -> None:
    if (name := _local(old)) is not None:
        os.replace(name, _local(new))
        return
    system, inner = fs.FileSystem.from_uri(old)
    system.move(inner, fs.FileSystem.from_uri(new)[1])


def write_whole(path: str, data: bytes) -> None:
    """A file that is there whole or not at all, also if the task is lost or runs twice."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open_write(part) as f:
        f.write(data)
    moved(part, path)


class WebFile(io.RawIOBase):
    """A file behind http or https, read by ranges where the server gives them, else whole."""

    def __init__(self, url: str):
        self.url, self._at = url, 0
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": "bytes=0-0"})) as answer:
            ranges = answer.headers.get("Content-Range") if answer.status == 206 else None
            self._whole = None if ranges else answer.read()
            self._size = int(ranges.rpartition("/")[2]) if ranges else len(self._whole)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + (0, self._at, self._size)[whence]
        return self._at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self._size - self._at)
        if n <= 0:
            return 0
        if self._whole is not None:
            data = self._whole[self._at : self._at + n]
        else:
            asked = urllib.request.Request(self.url, headers={"Range": f"bytes={self._at}-{self._at + n - 1}"})
            with urllib.request.urlopen(asked) as answer:
                data = answer.read()
        buffer[: len(data)] = data
        self._at += len(data)
        return len(data)


WEB = ("http://", "https://")


def open_raw(path: str) -> BinaryIO:
    if path.startswith(WEB):
        return io.BufferedReader(WebFile(path), 1 << 20)
    if "://" in path and not path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")


def open_input(path: str) -> BinaryIO:
    """A buffered stream, unzipped if it begins as gzip does."""
    raw = io.BufferedReader(open_raw(path), 1 << 20)
    if raw.peek(2)[:2] == b"\x1f\x8b":
        return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
    return raw
