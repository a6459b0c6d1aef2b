"""Image trees: one PNG per row, ``<root>/<folder>/<name>.png``.

A data source with a commit protocol. Tasks write into a draft folder of
their own inside ``<root>/_drafts-<job>``; when all have ended, the files of the
tasks that Spark accepted are moved to their folders, and when the job fails the
drafts are removed: a failed or repeated task leaves nothing behind. Spark's
``image`` source skips names that start with ``_``, so readers never see a draft.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

COLUMNS = "folder string, name string, height int, width int, channels int, data binary"
#: Files moved at once when a job is committed.
MOVES = 16


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG of 8-bit gray (1 channel) or red, green, blue (3), row by row."""
    if channels not in (1, 3) or len(data) != height * width * channels:
        raise ValueError(f"{len(data)} bytes are no {height} x {width} image of {channels} channels")
    stride = width * channels
    lines = b"".join(b"\0" + data[i:i + stride] for i in range(0, len(data), stride))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@dataclass
class Draft(WriterCommitMessage):
    """A task's draft folder and how many images it holds."""
    folder: str
    n: int


class ImageTreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.drafts = f"_drafts-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Draft:
        from pyspark import TaskContext
        context = TaskContext.get()
        fs, root = store_of(self.root)
        folder = f"{self.drafts}/{context.partitionId()}-{context.taskAttemptId()}"
        made, n = set(), 0
        for batch in iterator:
            for row in batch.to_pylist():
                if row["folder"] is None or row["name"] is None or row["data"] is None:
                    raise ValueError("an image needs a folder, a name and data")
                place = f"{root}/{folder}/{quote(row['folder'], safe='')}"
                if place not in made:
                    fs.create_dir(place, recursive=True)
                    made.add(place)
                path = f"{place}/{quote(row['name'], safe='')}.png"
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    raise ValueError(f"two images are named {row['folder']}/{row['name']}")
                with fs.open_output_stream(path) as sink:
                    sink.write(png(row["height"], row["width"], row["channels"], row["data"]))
                n += 1
        return Draft(folder, n)

    def commit(self, messages: list[Draft | None]) -> None:
        fs, root = store_of(self.root)
        moves = []
        for m in messages:
            if m is not None and m.n:
                base = f"{root}/{m.folder}/"
                found = fs.get_file_info(pafs.FileSelector(base.rstrip("/"), recursive=True))
                moves += [(f.path, f"{root}/{f.path[f.path.index(m.folder) + len(m.folder) + 1:]}") for f in found if f.type == pafs.FileType.File]
        targets = [t for _, t in moves]
        if len(set(targets)) < len(targets):
            raise ValueError("two images have one name")
        fs.create_dir(root, recursive=True)
        old = [f for f in fs.get_file_info(pafs.FileSelector(root)) if not f.base_name.startswith("_")]
        if self.overwrite:
            for f in old:
                fs.delete_dir(f.path) if f.type == pafs.FileType.Directory else fs.delete_file(f.path)
        elif old:
            taken = [f.path for f in fs.get_file_info(targets) if f.type != pafs.FileType.NotFound]
            if taken:
                raise ValueError(f"{len(taken)} images are there already, as {taken[0]}")
        for folder in {t.rpartition("/")[0] for t in targets}:
            fs.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda m: fs.move(*m), moves))
        self._clear(fs, root)

    def abort(self, messages: list[Draft | None]) -> None:
        self._clear(*store_of(self.root))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.drafts}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.drafts}")


class ImageTree(DataSource):
    """``df.write.format("image_tree").save(root)`` for rows of ``COLUMNS``."""

    @classmethod
    def name(cls) -> str:
        return "image_tree"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> ImageTreeWriter:
        return ImageTreeWriter(self.options["path"], overwrite)


def write_image_tree(images: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Write ``images`` (``COLUMNS``; data: bytes row by row, red, green, blue) as
    PNGs. ``append`` adds to a tree and refuses names it holds; two rows of one
    folder and name, or a row without folder, name or data, end the job, and
    nothing of it stays."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    images.sparkSession.dataSource.register(ImageTree)
    images.select(*names).write.format("image_tree").mode(mode).save(root)
