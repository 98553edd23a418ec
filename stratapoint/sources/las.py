"""Uncompressed LAS files as a Spark data source, read over ranges of points.

    spark.dataSource.register(LasSource)
    spark.read.format("las").option("paths", json.dumps([...])).load()

Every file is cut into ranges of `points_per_partition` points; a task reads only its range. Columns: file_index,
point_index, x, y, z, classification and the file's header fields needed to project it. A file that ends within a
record stops at the last whole record. Files of other kinds, compressed ones and those without points are refused.

With the option `skip_files` (and Spark's setting spark.sql.python.filterPushdown.enabled, which `read_las` puts on for it) comparisons of x, y, z,
file_index and crs_code with literals are pushed down: files whose header's box or CRS they rule out are not read. Of very many files, `headers` and `points_of` read headers and points in tasks and leave nothing to the driver.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stratapoint.functions import crs

POINTS_PER_PARTITION = 2_000_000
CHUNK = 65_536


@dataclass(frozen=True)
class Header:
    version: str
    header_size: int
    point_offset: int
    vlr_count: int
    point_format: int
    record_length: int
    point_count: int
    scale_x: float
    scale_y: float
    scale_z: float
    offset_x: float
    offset_y: float
    offset_z: float
    max_x: float
    min_x: float
    max_y: float
    min_y: float
    max_z: float
    min_z: float


def read_header(data: bytes, size: int) -> Header:
    """data: the first bytes of a file of `size` bytes."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file: the signature is missing")
    if len(data) < 227:
        raise ValueError("the LAS header is cut off")
    raw_format = data[104]
    if raw_format & 0x80 or (raw_format & 0x3F) > 10:
        raise ValueError("compressed LAS (LAZ) or an unknown point format; decompress the file first")
    header_size, point_offset, vlrs = struct.unpack_from("<HII", data, 94)
    length, count = struct.unpack_from("<HI", data, 105)
    if (data[24], data[25]) >= (1, 4) and len(data) >= 255 and (wide := struct.unpack_from("<Q", data, 247)[0]) > 0:
        count = wide
    if not count or not length or point_offset >= size:
        raise ValueError("the LAS file holds no points")
    return Header(f"{data[24]}.{data[25]}", header_size, point_offset, vlrs, raw_format & 0x3F, length, count, *struct.unpack_from("<12d", data, 131))


def text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").replace("\0", "").strip()


def read_vlrs(data: bytes, header: Header) -> list[dict]:
    """User id, record id, description and payload of each variable length record within data."""
    out, at = [], header.header_size
    for _ in range(header.vlr_count):
        if at + 54 > len(data):
            break
        record, length = struct.unpack_from("<HH", data, at + 18)
        out.append({"user_id": text(data[at + 2 : at + 18]), "record_id": record, "description": text(data[at + 22 : at + 54]), "data": data[at + 54 : at + 54 + length]})
        at += 54 + length
    return out


def geo_keys(data: bytes) -> dict[int, int]:
    """Keys whose value stands in the directory itself."""
    if len(data) < 8:
        return {}
    entries = (struct.unpack_from("<4H", data, 8 + 8 * i) for i in range(min(struct.unpack_from("<H", data, 6)[0], (len(data) - 8) // 8)))
    return {key: value for key, location, _, value in entries if location == 0}


def epsg_in(words: str) -> int | None:
    codes = [int(x) for x in re.findall(r"\d{4,5}", words)]
    for good in (crs.is_utm, lambda c: c in (crs.GEOGRAPHIC, crs.MERCATOR), lambda c: True):
        for code in filter(good, codes):
            return code
    return None


def crs_of(code: int, source: str) -> dict:
    """The same descriptor that functions.crs makes of a column; a code that cannot be projected is refused."""
    label = f"EPSG:{code}"
    if code in (crs.GEOGRAPHIC, crs.MERCATOR):
        return {"kind": "geographic" if code == crs.GEOGRAPHIC else "web-mercator", "code": code, "zone": None, "northern": None, "label": f"{label} ({source})"}
    if not crs.is_utm(code):
        raise ValueError(f"EPSG:{code} is neither geographic, Web Mercator nor UTM")
    zone, north = code % 100, code < crs.SOUTHERN
    return {"kind": "utm", "code": code, "zone": zone, "northern": north, "label": f"{label} UTM zona {zone}{'N' if north else 'S'} ({source})"}


#: How a guessed code is explained.
GUESSES = {
    crs.GEOGRAPHIC: "inferred from coordinate range",
    crs.MERCATOR: "inferred from coordinate range",
    crs.CANARY_ZONE: "inferred UTM 28N for the Canary Islands",
    crs.ELSEWHERE: "default assumption: Iberian Peninsula in Spain",
}


def guessed_crs(x: float, y: float) -> dict:
    radius = crs.MERCATOR_LIMIT / np.pi
    lng, lat = np.degrees(x / radius), np.degrees(2 * np.arctan(np.exp(np.clip(y / radius, -50, 50))) - np.pi / 2)
    code = crs.guess(x, y, lng, lat, lambda c, a, b: a if c else b)
    return crs_of(code, GUESSES[code])


def detect_crs(vlrs: list[dict], first: tuple[float, float]) -> dict:
    """From the WKT record, else from the GeoKeys, else guessed from the first point."""
    own = {v["record_id"]: v for v in reversed(vlrs) if "LASF_Projection" in v["user_id"]}
    if 2112 in own and (code := epsg_in(own[2112]["data"].decode("utf-8", "replace"))):
        return crs_of(code, "WKT")
    if 34735 in own:
        keys = geo_keys(own[34735]["data"])
        if code := epsg_in(str(keys.get(3072) or keys.get(2048) or "")):
            return crs_of(code, "GeoTIFF VLR")
    return guessed_crs(*first)


def store_of(path: str):
    """The file system of a path and its name there; Spark writes local paths as file:/a as well as file:///a."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return pyarrow.fs.LocalFileSystem(), path[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def is_las(path: str) -> bool:
    return path.lower().endswith(".las")


def inspect(path: str) -> tuple[Header, list[dict], dict, int]:
    """Header, variable length records, CRS and the number of whole point records of a file."""
    store, name = store_of(path)
    size = store.get_file_info(name).size
    with store.open_input_file(name) as f:
        header = read_header(f.read(375), size)
        f.seek(0)
        vlrs = read_vlrs(f.read(header.point_offset), header)
        f.seek(header.point_offset)
        raw = f.read(12)
        if len(raw) < 12:
            raise ValueError("the LAS file holds no points")
        x, y, _ = struct.unpack("<3i", raw)
    found = detect_crs(vlrs, (x * header.scale_x + header.offset_x, y * header.scale_y + header.offset_y))
    return header, vlrs, found, min(header.point_count, (size - header.point_offset) // header.record_length)


@dataclass
class PointRange(InputPartition):
    file_index: int
    path: str
    first: int
    last: int
    header: dict
    crs: dict


SCHEMA = """file_index int, point_index long, x double, y double, z double, classification int,
    crs_kind string, crs_code int, crs_zone int, crs_northern boolean, crs_label string"""


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (SkippingLasReader if self.options.get("skip_files", "false").lower() == "true" else LasReader)(self.options)


#: Files whose headers are looked at at once, where the driver must.
LOOKS = 32
_CRS_FIELDS = (("crs_kind", "kind", pa.string()), ("crs_code", "code", pa.int32()), ("crs_zone", "zone", pa.int32()), ("crs_northern", "northern", pa.bool_()), ("crs_label", "label", pa.string()))


@dataclass(frozen=True)
class Limit:
    """What a pushed comparison leaves of a column: low <= value <= high."""

    column: str
    low: float
    high: float

    @classmethod
    def of(cls, condition: Filter) -> Limit | None:
        name = getattr(condition, "attribute", (None,))
        if len(name) != 1 or name[0] not in ("x", "y", "z", "file_index", "crs_code"):
            return None
        values = condition.value if isinstance(condition, In) else [condition.value]
        if not values or not all(isinstance(v, (int, float)) for v in values):
            return None
        if isinstance(condition, (EqualTo, In)):
            return cls(name[0], min(values), max(values))
        if isinstance(condition, (GreaterThan, GreaterThanOrEqual)):
            return cls(name[0], values[0], float("inf"))
        if isinstance(condition, (LessThan, LessThanOrEqual)):
            return cls(name[0], float("-inf"), values[0])
        return None

    def may_hold(self, index: int, header: Header, found: dict) -> bool:
        if self.column in ("x", "y", "z"):
            low, high = sorted((getattr(header, f"min_{self.column}"), getattr(header, f"max_{self.column}")))
            step = abs(getattr(header, f"scale_{self.column}"))  # a header's limits may be rounded to the step
            return low - step <= self.high and high + step >= self.low
        value = index if self.column == "file_index" else found["code"]
        return self.low <= value <= self.high


class LasReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in (json.loads(options["paths"]) if "paths" in options else [options["path"]]) if is_las(p)]
        self.step = int(options.get("points_per_partition", POINTS_PER_PARTITION))
        self.limits: list[Limit] = []

    def partitions(self) -> list[PointRange]:
        out = []
        with ThreadPoolExecutor(LOOKS) as pool:
            for i, (path, (header, _, found, whole)) in enumerate(zip(self.paths, pool.map(inspect, self.paths))):
                if all(limit.may_hold(i, header, found) for limit in self.limits):
                    out += [PointRange(i, path, a, min(a + self.step, whole), asdict(header), found) for a in range(0, whole, self.step)]
        return out

    def read(self, partition: PointRange | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks once where no file is left
            yield from read_range(partition)


class SkippingLasReader(LasReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Every filter is still applied to the rows; what a header can tell about it rules out files."""
        self.limits += [limit for f in filters if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and (limit := Limit.of(f))]
        return filters


def read_range(part: PointRange) -> Iterator[pa.RecordBatch]:
    header = Header(**part.header)
    at = 16 if 6 <= header.point_format <= 10 else 15
    record = np.dtype({"names": ["x", "y", "z", "class"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, at], "itemsize": header.record_length})
    store, name = store_of(part.path)
    with store.open_input_file(name) as f:
        f.seek(header.point_offset + part.first * header.record_length)
        for first in range(part.first, part.last, CHUNK):
            n = min(CHUNK, part.last - first)
            points = np.frombuffer(f.read(n * header.record_length), record)
            x, y, z = (points[a] * getattr(header, f"scale_{a}") + getattr(header, f"offset_{a}") for a in "xyz")
            kinds = points["class"] if at == 16 else points["class"] & 0x1F
            system = [pa.array([part.crs[k]] * n, t) for _, k, t in _CRS_FIELDS]
            columns = [pa.array(np.full(n, part.file_index, np.int32)), pa.array(np.arange(first, first + n)), *map(pa.array, (x, y, z)), pa.array(kinds.astype(np.int32)), *system]
            yield pa.RecordBatch.from_arrays(columns, ["file_index", "point_index", "x", "y", "z", "classification", *(c for c, _, _ in _CRS_FIELDS)])


def read_las(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """The points of files; those of other kinds than .las are left out."""
    spark.dataSource.register(LasSource)
    if options.get("skip_files", "false") == "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("las").options(paths=json.dumps(paths), **options).load()


_KINDS = {"str": ("string", pa.string()), "int": ("long", pa.int64()), "float": ("double", pa.float64())}
_FIELDS = Header.__annotations__
HEADERS = f"file_index int, path string, {', '.join(f'{k} {_KINDS[t][0]}' for k, t in _FIELDS.items())}, vlr_ids array<long>, crs_kind string, crs_code int, crs_zone int, crs_northern boolean, crs_label string, whole_points long"
_HEADER_SCHEMA = pa.schema([
    ("file_index", pa.int32()), ("path", pa.string()), *((k, _KINDS[t][1]) for k, t in _FIELDS.items()), ("vlr_ids", pa.list_(pa.int64())),
    *((c, t) for c, _, t in _CRS_FIELDS), ("whole_points", pa.int64()),
])


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each file, made in tasks: its header, its records' ids, its CRS and how many whole points it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, path in zip(batch.column("file_index").to_pylist(), batch.column("path").to_pylist()):
                try:
                    header, vlrs, found, whole = inspect(path)
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from error
                rows.append((i, path, *asdict(header).values(), [v["record_id"] for v in vlrs], *(found[k] for _, k, _ in _CRS_FIELDS), whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HEADER_SCHEMA)], schema=_HEADER_SCHEMA) if rows else pa.RecordBatch.from_pylist([], _HEADER_SCHEMA)

    listed = [(i, p) for i, p in enumerate(p for p in paths if is_las(p))]
    rows = spark.createDataFrame(listed, "file_index int, path string").repartition(max(1, min(256, len(listed))), "file_index")
    return rows.mapInArrow(run, HEADERS)


def points_of(files: DataFrame, step: int = POINTS_PER_PARTITION, counter: Accumulator | None = None) -> DataFrame:
    """The points of the files of a table made by `headers`, read by ranges that Spark deals out; counter is told of the points read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = PointRange(row["file_index"], row["path"], row["_first"], min(row["_first"] + step, row["whole_points"]), {k: row[k] for k in _FIELDS}, {k: row[c] for c, k, _ in _CRS_FIELDS})
                for points in read_range(part):
                    yield points
                    if counter is not None:
                        counter.add(points.num_rows)

    ranges = files.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole_points") - 1, F.lit(step).cast("long")))).drop("vlr_ids")
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("whole_points") / step)), F.lit(0))).first()[0]
    return ranges.repartition(max(1, min(int(n), 20_000)), "file_index", "_first").mapInArrow(run, SCHEMA)


def class_histogram(points: DataFrame) -> DataFrame:
    """How many points of each class, as read, whether or not they can be projected."""
    return points.groupBy("classification").count()
