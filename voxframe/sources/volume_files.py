"""Byte ranges of files: plain ones of any file system that Arrow opens, behind http, or gzipped."""

from __future__ import annotations

import fnmatch
import glob
import gzip
import io
import re
import urllib.error
import urllib.request
import zlib
from pathlib import PurePosixPath

from pyarrow import fs


class Unreadable(ValueError):
    """A file doesn't hold what its header says: it is cut short, corrupt, of another kind, or has no numbers."""


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what stands before it in the URI."""
    local = re.match(r"file:/+", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), "/" + path[local.end() :] if local else path, ""
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


def is_remote(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def is_gzip(path: str) -> bool:
    return path.endswith(".gz")


def remote_size(path: str) -> int:
    """Bytes of a file behind http; zero if the server doesn't say."""
    with urllib.request.urlopen(urllib.request.Request(path, method="HEAD")) as answer:
        return int(answer.headers.get("Content-Length") or 0)


def listed(path: str, *patterns: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of a folder's files that match one of the patterns, or of files that match a path with wildcards."""
    if not path:
        return []
    if is_remote(path):
        return [(path, remote_size(path))]
    system, inside, before = located(path)
    if glob.has_magic(inside):
        fixed = inside[: re.search(r"[*?\[]", inside).start()].rpartition("/")[0] or "."
        found = system.get_file_info(fs.FileSelector(fixed, recursive=True, allow_not_found=True))
        found = [f for f in found if PurePosixPath(f.path).full_match(inside)]
        folders = [f.path for f in found if f.type == fs.FileType.Directory]
        files = [f for f in found if f.type == fs.FileType.File]
    else:
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        folders, files = ([inside], []) if info.type == fs.FileType.Directory else ([], [info])
    for folder in folders:
        files += [f for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File and any(fnmatch.fnmatch(f.base_name, p) for p in patterns)]
    # As Spark does, leave out what is hidden or still being written.
    return sorted({(before + f.path, f.size) for f in files if not _hidden(f.path, folders)})


def _hidden(path: str, folders: list[str]) -> bool:
    """Whether a name, or that of a folder below those that were asked for, begins with a dot or an underscore."""
    inside = next((path[len(f) :] for f in folders if path.startswith(f)), path.rpartition("/")[2])
    return any(name[:1] in tuple("._") for name in inside.split("/") if name)


def exists(path: str) -> bool:
    if is_remote(path):
        try:
            remote_size(path)
        except urllib.error.HTTPError:
            return False
        return True
    system, inside, _ = located(path)
    return system.get_file_info(inside).type == fs.FileType.File


class Inflated:
    """Byte ranges of a gzipped file, inflated no further than asked for; a range before the last one starts anew.

    Where the bytes aren't those of a gzip file, end too soon, or don't have the checksum that they should, it is Unreadable.
    """

    def __init__(self, path: str):
        if is_remote(path):
            with urllib.request.urlopen(path) as answer:
                self.raw = io.BytesIO(answer.read())
        else:
            system, inside, _ = located(path)
            self.raw = system.open_input_file(inside)
        self.file = gzip.GzipFile(fileobj=self.raw, mode="rb")

    def read(self, start: int, size: int) -> bytes:
        """The bytes from ``start`` on, ``size`` of them or as many as there are."""
        try:
            at = self.file.tell()
            if at > start:  # the header's bytes, read before, reach into the voxels
                at = self.file.seek(start)
            while at < start:
                step = self.file.read(min(1 << 20, start - at))
                if not step:
                    return b""
                at += len(step)
            return self.file.read(size)
        except (EOFError, zlib.error, gzip.BadGzipFile) as e:
            raise Unreadable(f"gzip: {e}") from e

    def verify(self, end: int) -> None:
        """Read on to the end, so that every checksum is seen; Unreadable if one is wrong or the content is shorter than ``end``."""
        try:
            while self.file.read(1 << 20):
                pass
        except (EOFError, zlib.error, gzip.BadGzipFile) as e:
            raise Unreadable(f"gzip: {e}") from e
        if self.file.tell() < end:
            raise Unreadable(f"its content has {self.file.tell()} bytes of {end}")

    def close(self) -> None:
        self.file.close()
        self.raw.close()


class Plain:
    def __init__(self, path: str):
        system, inside, _ = located(path)
        self.file = system.open_input_file(inside)

    def read(self, start: int, size: int) -> bytes:
        if start >= self.file.size():
            return b""
        self.file.seek(start)
        return self.file.read(size)

    def verify(self, end: int) -> None:
        """Unreadable if the file is shorter than ``end``; nothing is read."""
        if self.file.size() < end:
            raise Unreadable(f"it has {self.file.size()} bytes of {end}")

    def close(self) -> None:
        self.file.close()


class Ranged:
    """A file behind http, read by byte ranges; a server that ignores them sends the whole file, which is cut here."""

    def __init__(self, path: str):
        self.path = path

    def read(self, start: int, size: int) -> bytes:
        if not size:
            return b""
        asked = urllib.request.Request(self.path, headers={"Range": f"bytes={start}-{start + size - 1}"})
        try:
            with urllib.request.urlopen(asked) as answer:
                if answer.status != 206:
                    answer.read(start)
                return answer.read(size)
        except urllib.error.HTTPError as e:
            if e.code == 416:  # beyond the end
                return b""
            raise

    def verify(self, end: int) -> None:
        """Unreadable if the server says that the file is shorter than ``end``; nothing is read."""
        size = remote_size(self.path)
        if 0 < size < end:
            raise Unreadable(f"it has {size} bytes of {end}")

    def close(self) -> None:
        pass


def opened(path: str) -> Inflated | Plain | Ranged:
    return Inflated(path) if is_gzip(path) else Ranged(path) if is_remote(path) else Plain(path)
