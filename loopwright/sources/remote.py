"""Map bodies and parcel pages as data sources: mirrors in order, retries and checks inside the reader.

    spark.dataSource.register(Bodies)
    spark.read.format("map_bodies").option("sources", json.dumps([mirror, next_mirror])).load()

A source is a folder (any address that pyarrow's file systems know) with files `area=<area>/...`, pages with `area=<area>/offset=<offset>/...`, a JSON text in each. The files of all
sources are listed by the driver; a task fetches one of them, or of more than MOST several one after the other, each from the first source that has a good copy.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loopwright.schema import ELEMENTS, FEATURES
from loopwright.sources.elements import SOFT_FAILURE

#: Many small files cost a task less than a task costs: of more than so many, tasks get several, and so many at most.
MOST = 64

_KEY = re.compile(r"(?:^|/)area=([^/]+)/(?:offset=(\d+)/)?([^/_.][^/]*)$")


@dataclass
class Wanted(InputPartition):
    """One file: what it is of, and where each source that has it keeps it (source's number, address)."""

    area: str
    offset: int
    places: list[tuple[int, str]]


@dataclass
class Share(InputPartition):
    """Files that one task fetches."""

    files: list[Wanted]


def _listed(source: str) -> Iterator[tuple[str, int, str]]:
    """area, offset and address of a source's files; nothing of a source that can't be listed, which is one that failed."""
    from pyarrow import fs

    try:
        system, root = fs.FileSystem.from_uri(source) if "://" in source or source.startswith("file:") else (fs.LocalFileSystem(), source)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
    except Exception:
        return
    for info in found:
        m = _KEY.search(info.path[len(root) :])
        if m and info.type == fs.FileType.File:
            yield unquote(m.group(1)), int(m.group(2) or 0), source.rstrip("/") + info.path[len(root.rstrip("/")) :]


def fetched(address: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)
    with system.open_input_stream(path) as stream:
        return stream.read()


def put(address: str, body: str) -> None:
    """Writes one file, as fetched() reads it; a task that is tried again writes the same."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as stream:
        stream.write(body.encode())


def body_failure(body) -> str | None:
    """Why a map answer is no data, or None."""
    if not isinstance(body, dict) or not isinstance(body.get("elements"), list):
        return "not a map answer: it has no list of elements"
    if isinstance(body.get("remark"), str) and re.search(SOFT_FAILURE, body["remark"]):
        return f"the map server failed softly: {body['remark']}"
    return None if body["elements"] else "no element came back; the area may be empty or the server busy"


def page_failure(page) -> str | None:
    if isinstance(page, dict) and isinstance(page.get("error"), dict):
        return f"a parcel page is an error: {page['error'].get('message')}"
    return None if isinstance(page, dict) and isinstance(page.get("features"), list) else "not a parcel page: it has no list of features"


class _Reader(DataSourceReader):
    failure = staticmethod(body_failure)

    def __init__(self, options: dict[str, str], schema: pa.Schema):
        self.sources: list[str] = json.loads(options["sources"])
        self.retries = int(options.get("retries", 1))
        self.wait_s = float(options.get("wait", 0.0))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        found: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for number, source in enumerate(self.sources):
            for area, offset, address in _listed(source):
                found.setdefault((area, offset), []).append((number, address))
        if not found:
            raise ValueError(f"all sources failed: no file in any of {self.sources}")
        files = [Wanted(area, offset, places) for (area, offset), places in sorted(found.items())]
        shares = max(MOST, -(-len(files) // MOST))
        return files if len(files) <= MOST else [Share(files[k::shares]) for k in range(shares)]

    def read(self, partition: Wanted | Share) -> Iterator[pa.RecordBatch]:
        for wanted in partition.files if isinstance(partition, Share) else [partition]:
            yield self.first_good(wanted)

    def first_good(self, partition: Wanted) -> pa.RecordBatch:
        said = []
        for number, address in partition.places:
            for turn in range(self.retries + 1):
                try:
                    body = json.loads(fetched(address))
                    failure = self.failure(body)
                except Exception as error:  # not there, not readable, not JSON: one that failed
                    failure = str(error).splitlines()[0] if str(error) else type(error).__name__
                if failure is None:
                    return self.row(partition, body, number)
                said.append(f"{address}: {failure}")
                if turn < self.retries and self.wait_s:
                    time.sleep(self.wait_s * 2**turn)
        raise ValueError("all sources failed: " + "; ".join(dict.fromkeys(said)))

    def row(self, partition: Wanted, body: dict, number: int) -> pa.RecordBatch:
        keep = lambda e: {k: e.get(k) for k in ("type", "id", "lat", "lon", "nodes")} | {"tags": [(k, str(v)) for k, v in (e.get("tags") or {}).items()] if e.get("tags") is not None else None}
        return pa.RecordBatch.from_pylist([{"area": partition.area, "source": number, "remark": body.get("remark"), "elements": [keep(e) for e in body["elements"]]}], schema=self.schema)


class _PageReader(_Reader):
    failure = staticmethod(page_failure)

    def row(self, partition: Wanted, body: dict, number: int) -> pa.RecordBatch:
        """Column by column, for a page's nested rows convert slowly one by one."""
        of = self.schema.field("features").type
        attributes, geometry = (of.value_type.field(k).type for k in ("attributes", "geometry"))
        own = [f.get("attributes") or {} for f in body["features"]]
        text = lambda k: pa.array([None if x.get(k) is None else str(x[k]) for x in own], pa.string())
        rings = pa.array([(f.get("geometry") or {}).get("rings") for f in body["features"]], geometry.field("rings").type)
        features = pa.StructArray.from_arrays([pa.StructArray.from_arrays([text(x.name) for x in attributes], fields=list(attributes)), pa.StructArray.from_arrays([rings], fields=list(geometry))], fields=list(of.value_type))
        page = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), features, type=of)
        return pa.RecordBatch.from_arrays([pa.array([partition.area]), pa.array([number], pa.int32()), pa.array([partition.offset], pa.int64()), page, pa.array([body.get("exceededTransferLimit")], pa.bool_())], schema=self.schema)


class Bodies(DataSource):
    """Map bodies: area, source (the number of the mirror that had a good one), remark, elements."""

    @classmethod
    def name(cls) -> str:
        return "map_bodies"

    def schema(self) -> str:
        return f"area string, source int, remark string, elements {ELEMENTS}"

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Reader(dict(self.options), to_arrow_schema(schema))


class Pages(DataSource):
    """Parcel pages: area, source, offset, features, exceeded; houses.all_pages() says where they end."""

    @classmethod
    def name(cls) -> str:
        return "parcel_pages"

    def schema(self) -> str:
        return f"area string, source int, offset bigint, features {FEATURES}, exceeded boolean"

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _PageReader(dict(self.options), to_arrow_schema(schema))
