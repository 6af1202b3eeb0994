"""``spark.readStream.format("nifti")``: the files that arrive in a folder, each once, in any view.

An offset is the modification time and the path of the last file taken, and files follow each other in that order. So the
stream's checkpoint holds one pair whatever the number of files, and a restart goes on behind it. A file that arrives with a time
before that of one already taken, or with the same and a lesser path, isn't seen; ``lagSeconds`` leaves files alone until they are so old, so
that such stragglers are there before: on a store whose clock ticks in seconds, take a few. Files
should appear under their names when whole, as the sink's do. Within a batch large files are divided among tasks as in a scan.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSourceStreamReader

from .nifti import PATTERNS, SLAB_BYTES, Parts, partitioned, scan_of
from .volume_files import listed, located


class NiftiStreamReader(DataSourceStreamReader):
    def __init__(self, schema, options: dict):
        self.scan = scan_of(options)
        self.slab_bytes = int(options.get("slabbytes", SLAB_BYTES))
        self.lag = float(options.get("lagseconds", 0))
        self.patterns = [options["pathglobfilter"]] if options.get("pathglobfilter") else PATTERNS
        self.path = options["path"]

    def _files(self) -> list[tuple[int, str, int]]:
        """(time in nanoseconds, path, size) of the files that are old enough, in order."""
        system, _, before = located(self.path)
        sizes = dict(listed(self.path, *self.patterns))
        now = time.time_ns() - int(self.lag * 1e9)
        infos = system.get_file_info([p.removeprefix(before) if before else located(p)[1] for p in sizes])
        found = [(i.mtime_ns, before + i.path, i.size) for i in infos]
        return sorted((t, p, s) for t, p, s in found if t <= now)

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Parts]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        files = [(p, s) for t, p, s in self._files() if low < (t, p) <= high]
        return partitioned(files, self.scan, self.slab_bytes) if files else []

    def read(self, partition: Parts) -> Iterator:
        if self.scan.view == "header":
            return self.scan.headers(path for path, _, _ in partition.files)
        return self.scan.read(partition.files)
