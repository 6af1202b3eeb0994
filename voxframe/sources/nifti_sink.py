"""``df.write.format("nifti").mode("append").save(folder)``: volumes or slabs as NIfTI files.

Rows have name, nx, ny, nz and data (stored numbers, not yet rescaled, x fastest), and may have datatype (16), order ('<'), nt (1),
dx, dy, dz (1), scl_slope (1) and scl_inter (0). A row is a whole volume; or, with a column z and, where nt is above 1, t, one
slab of it: then all slabs of a name follow each other by (t, z) in one task, as ``repartition("name").sortWithinPartitions("name", "t", "z")``
deals them, and no volume is ever in memory as a whole. A name that ends in .gz is gzipped.

Tasks write drafts into a hidden folder beside the files, and only the driver's commit gives them their names, so a task that fails or
runs twice leaves nothing. ``append`` refuses names that are there already; ``overwrite`` replaces the folder's volumes.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .nifti_header import write_header
from .volume_files import is_gzip, listed, located

#: Columns that rows have to have, and what others are where they don't.
NEEDED = ("name", "nx", "ny", "nz", "data")
DEFAULTS = {"datatype": 16, "order": "<", "nt": 1, "dx": 1.0, "dy": 1.0, "dz": 1.0, "scl_slope": 1.0, "scl_inter": 0.0}


@dataclass
class Drafts(WriterCommitMessage):
    """Files that one task has written, (draft, name)."""

    files: list[tuple[str, str]]


class _Draft:
    """One file while it is written."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str, row: dict, version: int):
        from .nifti import DTYPES

        if row["datatype"] not in DTYPES:
            raise ValueError(f"{name}: type {row['datatype']} is none of numbers")
        if "/" in name or name[:1] in "._" or not name.removesuffix(".gz").endswith(".nii"):
            raise ValueError(f"{name!r}: names are plain and end in .nii or .nii.gz")
        self.name, self.path = name, f"{folder}/{uuid.uuid4().hex}"
        self.dtype = np.dtype(row["order"] + DTYPES[row["datatype"]])
        self.shape = tuple(row[c] for c in ("nx", "ny", "nz", "nt"))
        self.written = 0
        self.exits = ExitStack()
        out = self.exits.enter_context(system.open_output_stream(self.path, compression=None))
        # The same content gives the same bytes: no time and no name in the gzip header.
        self.out = self.exits.enter_context(gzip.GzipFile(filename="", mode="wb", compresslevel=1, fileobj=out, mtime=0)) if is_gzip(name) else out
        shape = self.shape if self.shape[3] > 1 else self.shape[:3]
        spacing = [1.0, row["dx"], row["dy"], row["dz"], 1.0, 1.0, 1.0, 1.0]
        self.out.write(write_header(shape, row["datatype"], version, row["order"], pixdim=spacing, scl_slope=row["scl_slope"], scl_inter=row["scl_inter"]))

    def add(self, row: dict, data: np.ndarray) -> None:
        nx, ny, nz, nt = self.shape
        if row.get("z") is not None:
            at = (row.get("t") or 0) * nz + row["z"]
            if (at * nx * ny, nx * ny) != (self.written, len(data)):
                raise ValueError(f"{self.name}: slab t={row.get('t')}, z={row['z']} of {len(data)} voxels is out of order or of another size")
        self.out.write(memoryview(np.ascontiguousarray(data.astype(self.dtype))).cast("B"))
        self.written += len(data)

    def close(self) -> tuple[str, str]:
        self.exits.close()
        if self.written != np.prod(self.shape, dtype=np.int64):
            raise ValueError(f"{self.name}: {self.written} voxels of {self.shape}")
        return self.path, self.name


class NiftiWriter(DataSourceArrowWriter):
    def __init__(self, schema, options: dict, overwrite: bool):
        missing = [c for c in NEEDED if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"columns {', '.join(missing)} are missing")
        self.folder, self.overwrite = options["path"], overwrite
        self.version = int(options.get("version", 1))
        self.names = schema.fieldNames()
        self.drafts = f"{located(self.folder)[1].rstrip('/')}/_writing-{uuid.uuid4().hex}"
        # Made by the driver alone: a task that begins after the job was given up finds no folder, and makes none.
        located(self.folder)[0].create_dir(self.drafts, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        system = located(self.folder)[0]
        done, draft = [], None
        try:
            for rows in iterator:
                small = [c for c in self.names if c in ("name", "nx", "ny", "nz", "t", "z", *DEFAULTS)]
                plain = {c: rows.column(self.names.index(c)).to_pylist() for c in small}
                data = rows.column(self.names.index("data"))
                for r in range(rows.num_rows):
                    row = DEFAULTS | {c: v[r] for c, v in plain.items() if v[r] is not None}
                    if draft is None or draft.name != row["name"] or row.get("z") is None:
                        if draft is not None:
                            done.append(draft.close())
                        draft = _Draft(system, self.drafts, row["name"], row, self.version)
                    values = data[r].values
                    if values is None or values.null_count:
                        raise ValueError(f"{row['name']}: null data")
                    draft.add(row, values.to_numpy(zero_copy_only=False))
            if draft is not None:
                done.append(draft.close())
        except BaseException:
            if draft is not None:
                draft.exits.close()
            for path, _ in done:
                system.delete_file(path)
            raise
        return Drafts(done)

    def commit(self, messages: list[Drafts | None]) -> None:
        system, inside, before = located(self.folder)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        try:
            twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
            if twice:
                raise ValueError(f"written twice: {', '.join(twice[:5])}")
            there = {p.rpartition("/")[2] for p, _ in listed(self.folder, "*.nii", "*.nii.gz")} if system.get_file_info(inside).type == fs.FileType.Directory else set()
            if self.overwrite:
                for name in there - set(names):
                    system.delete_file(f"{inside}/{name}")
            elif there & set(names):
                raise ValueError(f"there already: {', '.join(sorted(there & set(names))[:5])}")
            system.create_dir(inside, recursive=True)
            for draft, name in files:
                system.move(draft, f"{inside}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Drafts | None]) -> None:
        """Drafts go, also those of tasks that ended without a message."""
        system = located(self.folder)[0]
        if system.get_file_info(self.drafts).type == fs.FileType.Directory:
            system.delete_dir(self.drafts)
