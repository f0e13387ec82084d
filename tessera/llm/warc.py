"""Deterministic sharded WARC writer and the reader that takes its archives back.

Records are range-sorted by page_id (then payload digest) into shards of some ``shard_bytes`` of payload each, whose
borders follow from the table alone: running byte sums in that order, so no outlying id moves them, and every run writes
the same archives. A task writes its shards as a stream: each record is a gzip member of its own with a regenerated
header, id, block and payload digest; a file is closed and the next begun once it exceeds ``roll_bytes`` compressed.
Files are written under temporary names of their attempt; tasks then move those of the attempts that counted to their
final names (a move that has happened already is none), and the driver writes the manifest, again through a temporary
name. Readers open only what the manifest lists, so what a lost attempt left behind is never read. What the driver holds
is one border for each shard.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a response and the others
are revisits that refer to it. Rows that repeat that page_id with that payload are responses each. A null page_id comes
first and is a revisit if a payload equal to its own has a page_id, else a response; null html is an empty payload; a
null url is written as ``urn:page:<page_id>``. An empty table gives no archive and an empty manifest. Other columns are ignored.
Rows with one page_id and one payload share a shard, however many.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut

#: Tasks that write at a time; more shards share them.
MOST_TASKS = 20_000
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long, sha256 string, temporary string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string"


def filesystem(uri: str):
    """The store of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def header(fields: list[tuple[str, object]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: header, block, two line ends."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", f"urn:page:{page_id}" if url is None else url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, digest)),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
        ("X-Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return gzip.compress(header(fields) + block + b"\r\n\r\n", 6, mtime=0)


def info(name: str) -> bytes:
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    return gzip.compress(header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block + b"\r\n\r\n", 6, mtime=0)


def with_notes(pages: DataFrame, least: int = 0) -> DataFrame:
    """Every row of pages (page_id, url, html, digest), and before it in the order of (page_id, digest, note) a narrow row for each revisit's page_id and digest that holds refers_to alone. So the payloads are shuffled once, to be sorted, and meet no join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    narrow = keyed.where(F.octet_length("html") >= least).select("page_id", "digest")
    # counted per digest with a partial aggregate first; Spark can split the join of a frequent digest
    again = narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    revisits = narrow.join(again, "digest").where(~F.col("page_id").eqNullSafe(F.col("last"))).groupBy("page_id", "digest").agg(F.max("last").alias("refers_to"))
    text = F.lit(None).cast("string")
    return keyed.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("note")).unionByName(revisits.select("page_id", text.alias("url"), text.alias("html"), "digest", "refers_to", F.lit(0).alias("note")))


def borders(pages: DataFrame, shard_bytes: int) -> tuple[list, list]:
    """The page_ids and digests with which the shards begin, in order."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column(2).to_numpy()
            ends = seen + np.cumsum(size)
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - size), pa.array(ends), pa.array(np.full(len(size), part, np.int64))], names=["page_id", "digest", "low", "high", "part"])

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sizes = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"), F.octet_length(html).cast("long").alias("size")).groupBy("page_id", "digest").agg(F.sum("size").alias("size"))
    placed = cut(sizes.repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest").mapInArrow(running, "page_id long, digest binary, low long, high long, part long"))
    before, total = {}, 0
    for part, high in placed.groupBy("part").agg(F.max("high")).orderBy("part").collect():  # a row for each partition
        before[part], total = total, total + high
    shift = placed.sparkSession.createDataFrame(list(before.items()) or [(-1, 0)], "part long, shift long")
    shard = F.floor((F.col("low") + F.col("shift")) / shard_bytes)
    found = placed.join(F.broadcast(shift), "part").groupBy(shard.alias("shard")).agg(F.min(F.struct("page_id", "digest")).alias("first")).orderBy("shard").collect()  # a row for each shard
    drop_cut(placed)
    return [r.first.page_id for r in found], [bytes(r.first.digest) for r in found]


def with_shards(rows: DataFrame, pages: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``shard`` to rows (page_id, digest, ...); and the number of shards."""
    ids, digests = borders(pages, shard_bytes)
    held = rows.sparkSession.sparkContext.broadcast((ids, digests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests = held.value
        nulls = sum(x is None for x in ids)
        known = np.array(ids[nulls:], np.int64)
        for batch in batches:
            page, digest = (batch.column(batch.schema.names.index(c)) for c in ("page_id", "digest"))
            none = page.is_null().to_numpy(zero_copy_only=False)
            x = page.fill_null(0).to_numpy()
            low = np.where(none, 0, nulls + np.searchsorted(known, x, "left"))
            high = np.where(none, nulls, nulls + np.searchsorted(known, x, "right"))
            for i in np.flatnonzero(low < high).tolist():  # a shard begins within this page_id
                high[i] = bisect.bisect_right(digests, digest[i].as_py(), int(low[i]), int(high[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.maximum(high - 1, 0))], names=[*batch.schema.names, "shard"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.LongType())])), max(1, len(ids))


def _moved(out: str):
    """Moves files to their final names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = filesystem(out)
        for frame in frames:
            for path, temporary in zip(frame["path"], frame["temporary"], strict=True):
                if store.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{root}/{temporary}", f"{root}/{path}")
                elif store.get_file_info(f"{root}/{path}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(path)
            yield frame

    return run


def _writer(out: str, roll_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(out)
        attempt = uuid.uuid4().hex
        state: dict = {}
        done: list[tuple] = []

        def close() -> None:
            if state:
                state["file"].close()
                done.append((state["path"], state["records"], state["bytes"], state["sha"].hexdigest(), state["temporary"]))
                state.clear()

        def put(data: bytes) -> None:
            state["file"].write(data)
            state["sha"].update(data)
            state["bytes"] += len(data)

        def begin(shard: int, part: int) -> None:
            name = f"shard-{shard:06d}-{part:04d}.warc.gz"
            temporary = f"_temporary/{name}.{attempt}"
            state.update(shard=shard, part=part, path=name, temporary=temporary, records=0, bytes=0, sha=hashlib.sha256(), file=store.open_output_stream(f"{root}/{temporary}"))
            put(info(name))

        note: tuple = ()
        for frame in frames:
            for shard, page_id, url, html, digest, refers_to in zip(*(frame[c] for c in ("shard", "page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                if html is None:
                    note = page_id, digest, int(refers_to)
                    continue
                if state and (state["shard"] != shard or state["bytes"] >= roll_bytes):
                    part = state["part"] + 1 if state["shard"] == shard else 0
                    close()
                    begin(shard, part)
                elif not state:
                    begin(shard, 0)
                put(record(page_id, url, html.encode(), note[2] if note[:2] == (page_id, digest) else None))
                state["records"] += 1
        close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes", "sha256", "temporary"])

    return run


def write(pages: DataFrame, out: str, shard_bytes: int = 64 << 20, roll_bytes: int = 256 << 20, least: int = 0) -> None:
    """Write every row of pages (page_id, url, html) as a WARC record below ``out``, a folder that all tasks reach."""
    store, root = filesystem(out)
    store.create_dir(f"{root}/_temporary", recursive=True)
    rows, shards = with_shards(with_notes(pages, least), pages, shard_bytes)
    tasks = min(shards, MOST_TASKS)
    # a task has every so manieth shard, and its rows come in order
    rows = rows.repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard", "page_id", "digest", "note", "url")
    rows = rows.select("shard", F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    files = cut(rows.mapInPandas(_writer(out, roll_bytes), MANIFEST))
    done = cut(files.repartition(tasks, "path").mapInPandas(_moved(out), MANIFEST))
    with store.open_output_stream(f"{root}/_temporary/manifest.jsonl") as f:
        for r in done.orderBy("path").toLocalIterator():  # one row a file
            f.write((json.dumps({"path": r.path, "records": r.records, "bytes": r.bytes, "sha256": r.sha256}) + "\n").encode())
    store.move(f"{root}/_temporary/manifest.jsonl", f"{root}/manifest.jsonl")
    store.delete_dir(f"{root}/_temporary")
    drop_cut(files)
    drop_cut(done)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a compressed stream; memory for one record."""
    buffer, inflate, more = bytearray(), zlib.decompressobj(31), True
    pending = b""

    def fill() -> bool:
        nonlocal inflate, pending
        if not pending:
            pending = stream.read(1 << 18)
        if not pending:
            return False
        buffer.extend(inflate.decompress(pending))
        pending = b""
        if inflate.eof:
            pending, inflate = inflate.unused_data, zlib.decompressobj(31)
        return True

    while more:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and (more := fill()):
            pass
        if end < 0:
            if buffer.strip():
                raise ValueError("a record's header is cut off")
            return
        lines = buffer[:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        while len(buffer) < end + 8 + size:
            if not fill():
                raise ValueError("a record's block is cut off")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]
        yield fields, block


def read(spark: SparkSession, out: str, payload: bool = False) -> DataFrame:
    """A row for each response and revisit of the archives in the manifest, digests verified; with its payload (null in revisits) if asked for."""
    store, root = filesystem(out)
    with store.open_input_stream(f"{root}/manifest.jsonl") as f:
        listed = [json.loads(x) for x in f.read().decode().splitlines()]
    schema = RECORD + ", payload binary" * payload

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in schema.split(", ")]
        store, root = filesystem(out)
        for frame in frames:
            for path in frame["path"]:
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(f"{root}/{path}", compression=None) as f:
                    for fields, block in records(f):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"{path}: a block doesn't match its digest")
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = fields["WARC-Type"] == "response"
                        if response and (digest != digest32(body) or len(body) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        url = fields["WARC-Target-URI"]
                        rows.append((number("X-Page-Id"), None if url.startswith("urn:page:") else url, fields["WARC-Type"], number("X-Payload-Length"), digest, number("X-Refers-To-Page-Id"), path, *([body if response else None] * payload)))
                        held += len(body) if payload else 0
                        if len(rows) >= 10_000 or held > 16 << 20:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                yield _frame(rows, columns)

    tasks = max(1, min(len(listed), 10_000))
    files = spark.createDataFrame([(x["path"],) for x in listed], "path string").repartition(tasks)
    return files.mapInPandas(run, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})
