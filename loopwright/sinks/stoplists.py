"""Stop lists as CSV files, by a data sink that streams the ordered rows of each area.

    write_stop_lists(stop_rows, folder)

Rows are range-sorted by (area, group, order). A task writes the lines of the areas in its range, one by one, to staged files; the commit moves them to `area=<area>/part-....csv`, so a
failed or repeated task leaves nothing behind. The files of an area, in order of their names, are its text: the header is in the first one only. No area is held in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loopwright.functions import text as T
from loopwright.sinks.export import HEADER

END = "\r\n"


@dataclass
class Staged(WriterCommitMessage):
    """Staged files and where they belong."""

    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def _system(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, root = self._system()
        staging = f"{root}/{self.staging[len(self.path) + 1 :]}/{uuid.uuid4().hex}"
        moves: list[tuple[str, str]] = []
        area, out = None, None
        try:
            for row in rows:
                if out is None or row["area"] != area:
                    if out is not None:
                        out.close()
                    area = row["area"]
                    folder = "area=" + (quote(area, safe=" ") if area is not None else "__HIVE_DEFAULT_PARTITION__")
                    name = f"part-{row['group'] or 0:09d}-{row['order'] or 0:012d}-{uuid.uuid4().hex[:8]}.csv"
                    system.create_dir(staging, recursive=True)
                    moves.append((f"{staging}/{len(moves)}", f"{root}/{folder}/{name}"))
                    out = system.open_output_stream(moves[-1][0])
                out.write(row["line"].encode())
        finally:
            if out is not None:
                out.close()
        return Staged(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, root = self._system()
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.type == fs.FileType.Directory and "/area=" in info.path:
                    system.delete_dir(info.path)
        for message in messages:
            for source, target in message.moves if message else []:
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                system.move(source, target)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = self._system()
        staging = f"{root}/{self.staging[len(self.path) + 1 :]}"
        try:
            system.delete_dir(staging)
        except FileNotFoundError:  # nothing was staged
            pass


class StopLists(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stop_lists"

    def schema(self) -> str:
        return "area string, group int, order int, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def lines(stop_rows: DataFrame) -> DataFrame:
    """area, group, order, line: each stop's text with its line end; an area's first stop has the header before it."""
    fields = [F.col("group").cast("string"), F.col("order").cast("string"), T.csv_field(T.neutralise(F.col("address"))), F.col("lat").cast("string"), F.col("lon").cast("string")]
    place = F.struct("group", "order")
    first = stop_rows.groupBy(F.col("area").alias("a")).agg(F.min(place).alias("first"))
    met = stop_rows.join(first, F.col("area").eqNullSafe(F.col("a")))
    line = F.concat(F.concat_ws(",", *fields), F.lit(END))
    return met.select("area", F.col("group").cast("int").alias("group"), F.col("order").cast("int").alias("order"), F.when(place == F.col("first"), F.concat(F.lit(",".join(HEADER) + END), line)).otherwise(line).alias("line"))


def write_stop_lists(stop_rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Without a stop there is nothing to write, which is an error."""
    if stop_rows.isEmpty():
        raise ValueError("no stops to export: solve an area first")
    spark = stop_rows.sparkSession
    spark.dataSource.register(StopLists)
    order = ["area", "group", "order"]
    dealt = lines(stop_rows).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.format("stop_lists").option("path", path).mode("overwrite" if overwrite else "append").save()
