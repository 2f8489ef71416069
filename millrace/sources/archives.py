"""ZIP archives as tables of their members, a data source that plans by the archives' own directories.

The driver reads each archive's central directory only; tasks then read ranges of members. So an archive of any size is
split over tasks, and a filter on names decides what is read at all.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .files import work_path, written

_SCHEMA = "archive string, name string, size bigint, content binary"


def _opened(path: str):
    """A seekable file of whatever store the path names: its file system and place come from its scheme."""
    fs, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(place)


def _archives(path: str) -> list[str]:
    """The archive itself, or all archives below a folder."""
    fs, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    if fs.get_file_info(place).type != pyarrow.fs.FileType.Directory:
        return [path]
    head = path[: len(path.rstrip("/")) - len(place.rstrip("/"))] if path.rstrip("/").endswith(place.rstrip("/")) else ""
    found = fs.get_file_info(pyarrow.fs.FileSelector(place, recursive=True))
    return sorted(head + f.path for f in found if f.is_file and f.path.lower().endswith(".zip"))


@dataclass
class Members(InputPartition):
    """Members of an archive, read by one task."""

    archive: str
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split("\n") if p]
        self.bytes = int(options.get("partitionbytes", 32 << 20))
        self.wanted: list[tuple[str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names that are equal to, in, or begin with something are settled here; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.wanted.append(("in", (f.value,)))
            elif isinstance(f, In) and f.attribute == ("name",):
                self.wanted.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.wanted.append(("starts", (f.value,)))
            else:
                yield f

    def _asked(self, name: str) -> bool:
        return all(name in values if kind == "in" else name.startswith(values) for kind, values in self.wanted)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for archive in (a for p in self.paths for a in _archives(p)):
            with _opened(archive) as f, zipfile.ZipFile(f) as z:
                names, size = [], 0
                for m in sorted(z.infolist(), key=lambda m: m.header_offset):
                    if m.is_dir() or not self._asked(m.filename):
                        continue
                    if names and size + m.file_size > self.bytes:
                        out.append(Members(archive, names))
                        names, size = [], 0
                    names.append(m.filename)
                    size += m.file_size
                if names:
                    out.append(Members(archive, names))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        with _opened(partition.archive) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                data = z.read(name)
                yield pa.RecordBatch.from_arrays([pa.array([partition.archive]), pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["archive", "name", "size", "content"])


class ArchiveSource(DataSource):
    """Format `zip_members`; options: path (an archive or a folder of them; several parted by line feeds), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, partition_bytes: int = 32 << 20) -> DataFrame:
    """archive, name, size, content of all members (folders aside) of an archive or of the archives below a folder.

    Of members of the same name in one archive the last counts. A filter on name (equal, in, begins with) is settled from
    the archives' directories, before anything else of them is read. Paths must be in a store that Python's Arrow reaches.
    """
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("zip_members").option("path", path).option("partitionBytes", partition_bytes).load()


def write_archives(rows: DataFrame, name: str, content: str, path: str, members: int = 1000) -> DataFrame:
    """Writes rows as archives of about so many members below a folder; returns archive and its members' number.

    Rows without a name are left out, null contents are empty. A repeated task writes anew under another name; only the
    archives in the result, which is a written table, count, and others may be left over from lost tasks.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // members))
    dealt = rows.filter(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("name"), F.coalesce(F.col(content).cast("string"), F.lit("")).cast("binary").alias("content")).repartition(parts, "name")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held, n = io.BytesIO(), 0
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for i in range(batch.num_rows):
                    z.writestr(zipfile.ZipInfo(batch.column(0)[i].as_py()), batch.column(1)[i].as_py())
                    n += 1
        if n:
            fs, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
            fs.create_dir(place, recursive=True)
            file = f"pages-{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{place}/{file}") as out:
                out.write(held.getbuffer())
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{file}"]), pa.array([n], pa.int64())], ["archive", "members"])

    return written(dealt.mapInArrow(pack, "archive string, members long"), "archives")


def bundle_title(names: Sequence[str]) -> tuple[str, str, str] | None:
    """(year, brand, model) from the one folder above all members, `<year> <brand> <model>/`; None if it is not of that form."""
    tops = {n.split("/", 1)[0] for n in names if "/" in n}
    parts = next(iter(tops)).split(" ", 2) if len(tops) == 1 and all("/" in n for n in names) else []
    return (parts[0], parts[1], parts[2]) if len(parts) == 3 and parts[0].isdigit() and len(parts[0]) == 4 else None


def archived(rows: DataFrame, name: str, content: str) -> DataFrame:
    """Rows written to archives in the work folder and read back."""
    spark = rows.sparkSession
    made = write_archives(rows, name, content, work_path(spark, "zip"))
    return read_archives(spark, "\n".join(r["archive"] for r in made.select("archive").collect()))
