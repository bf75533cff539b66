"""Vendor call records as a data source: frames of bytes in files, read in batch or as a stream, bad ones kept apart.

    register(spark)
    spark.read.format("vendor_frames").load(path)                        # path/<vendor>/<file>
    spark.readStream.format("vendor_frames").option("filesPerBatch", 4).load(path)
"""

from __future__ import annotations

import base64
import glob
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from tidewatch.operators.ingest import VOICE_KINDS, kind, voice

FRAME = "vendor string, file string, at long, vendor_id string, event_type string, caller string, callee string, ts_ms long, imei string, reason string, raw string"
MAGIC = b"\xc5\xdd"  # of a binary frame: magic, length of the body (2 bytes), body, sum of the body's bytes (1 byte)
TAGS = {1: "cdr_id", 2: "event_type", 3: "caller", 4: "callee", 5: "timestamp_ms", 6: "imei"}


def json_frames(data: bytes) -> Iterator[tuple[int, bytes, dict | str]]:
    """(place, bytes, record or what is wrong) of each line; blank lines are none."""
    at = 0
    for line in data.split(b"\n"):
        if line.strip():
            try:
                own = json.loads(line)
                yield at, line, own if isinstance(own, dict) else "not a record"
            except ValueError:
                yield at, line, "not JSON"
        at += len(line) + 1


def tagged_frames(data: bytes) -> Iterator[tuple[int, bytes, dict | str]]:
    """The same of binary frames. After a broken one the next magic is looked for, so one loss does not lose the file."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != MAGIC:
            end = data.find(MAGIC, at + 1)
            end = len(data) if end < 0 else end
            yield at, data[at:end], "no magic"
            at = end
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0] if at + 4 <= len(data) else 0
        end = at + 5 + size
        body = data[at + 4 : end - 1]
        if end > len(data) or sum(body) % 256 != data[end - 1]:
            end = data.find(MAGIC, at + 2)
            end = len(data) if end < 0 else end
            yield at, data[at:end], "broken frame"
        else:
            yield at, data[at:end], _fields(body)
        at = end


def _fields(body: bytes) -> dict | str:
    out, at = {}, 0
    while at < len(body):
        if at + 2 > len(body) or at + 2 + body[at + 1] > len(body):
            return "broken field"
        value = body[at + 2 : at + 2 + body[at + 1]]
        name = TAGS.get(body[at])
        if name == "timestamp_ms":
            out[name] = int.from_bytes(value, "big")
        elif name:
            try:
                out[name] = value.decode()
            except UnicodeDecodeError:
                return "broken text"
        at += 2 + len(value)
    return out


PARSERS = {"generic": json_frames, "tagged": tagged_frames}


def canonical(own: dict | str) -> tuple:
    """(vendor_id, event_type, caller, callee, ts_ms, imei, reason) of a record: needs a kind, a caller and a time from 0 on."""
    if isinstance(own, str):
        return None, None, None, None, None, None, own
    text = lambda name: v if isinstance(v := own.get(name), str) and v else None
    ts, kind = own.get("timestamp_ms"), text("event_type")
    wrong = "no kind" if not kind or len(kind) > 32 else "no caller" if text("caller") is None else "no time" if not isinstance(ts, int) or isinstance(ts, bool) or not 0 <= ts < 2**63 else None
    if wrong:
        return None, None, None, None, None, None, wrong
    return text("cdr_id"), kind, text("caller"), text("callee"), ts, text("imei"), None


@dataclass
class File(InputPartition):
    vendor: str
    path: str


def _read(part: File) -> Iterator[tuple]:
    with open(part.path, "rb") as f:
        data = f.read()
    for at, raw, own in PARSERS[part.vendor](data):
        *fields, reason = canonical(own)
        yield (part.vendor, os.path.basename(part.path), at, *fields, reason, None if reason is None else base64.b64encode(raw).decode())


def _files(path: str, vendors: set[str]) -> list[File]:
    return [File(v, f) for v in sorted(vendors & set(PARSERS)) for f in sorted(glob.glob(os.path.join(path, v, "*")))]


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.vendors = path, set(PARSERS)

    def pushFilters(self, filters: list[Filter]):
        """Filters on the vendor choose the folders; the others are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("vendor",):
                self.vendors &= {f.value}
            elif isinstance(f, In) and f.attribute == ("vendor",):
                self.vendors &= set(f.value)
            else:
                yield f

    def partitions(self) -> list[File]:
        return _files(self.path, self.vendors) or [File("generic", os.devnull)]

    def read(self, partition: File) -> Iterator[tuple]:
        return _read(partition)


class FrameStreamReader(DataSourceStreamReader):
    """Files in the order of their names, vendor by vendor; the offset is the last name read of each vendor.

    Names must rise as files come, as those of probes with a time in front do. A file must be whole when it appears.
    """

    def __init__(self, path: str, per_batch: int):
        self.path, self.per_batch, self.at = path, per_batch, {}

    def initialOffset(self) -> dict:
        return {v: "" for v in PARSERS}

    def _after(self, start: dict) -> list[File]:
        return [f for f in _files(self.path, set(PARSERS)) if os.path.basename(f.path) > start.get(f.vendor, "")]

    def latestOffset(self) -> dict:
        start = {**self.initialOffset(), **self.at}
        for f in self._after(start)[: self.per_batch]:
            start[f.vendor] = max(start[f.vendor], os.path.basename(f.path))
        self.at = start
        return start

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.at = {**self.at, **{v: max(n, self.at.get(v, "")) for v, n in end.items()}}  # where a restart goes on
        return [f for f in self._after(start) if os.path.basename(f.path) <= end.get(f.vendor, "")]

    def read(self, partition: File) -> Iterator[tuple]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """Frames below path/<vendor>/: JSON lines of "generic", binary frames of "tagged". A file is one task.

    The folder must be one that driver and executors see as files.
    """

    @classmethod
    def name(cls) -> str:
        return "vendor_frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"])

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(self.options["path"], int(self.options.get("filesPerBatch", 1000)))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach Python sources, which is off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def canonical_voice(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(voice events, dead letters) of frames, in batch or as a stream: also frames of unknown kinds are dead letters."""
    own = frames.where("reason is null")
    dead = frames.where("reason is not null").select("vendor", "file", "at", F.col("raw").alias("value"), "reason")
    record = F.to_json(F.struct("vendor_id", "event_type", "caller", "callee", "ts_ms", "imei"))
    odd = own.where(kind(F.col("event_type"), VOICE_KINDS).isNull()).select("vendor", "file", "at", F.base64(record.cast("binary")).alias("value"), F.lit("unknown kind").alias("reason"))
    return voice(own).where("kind is not null"), dead.unionByName(odd)
