"""Deterministic sharded WARC writer and reader.

Records are range-sorted by (record id, payload digest, address): ranges of keys become
shards, and each shard is written in order.  The bounds of the ranges come from the keys
alone: of the keys picked by a hash of their own, those that cut the payload bytes into equal
parts.  So the same rows give the same shards in any run, on any cluster.  A shard rolls to a
new file when the compressed size reaches a limit.  Every record is a gzip member of its own; its headers
(record id from the key, lengths, block and payload digests) are generated from the
payload, so the same rows give the same bytes.

Of records with equal payloads of at least ``REVISIT_FROM`` bytes the one with the
largest id is a response, the others are revisits that refer to it and carry no payload.
Which rows revisit is found on digests alone; each such mark then travels as a row of its
own through the same range sort as the pages and arrives just before its page, so the
payloads are shuffled once and a payload that many pages share makes no hot task.

Commit: a task writes files under temporary names and returns one manifest row per file
(temporary name, final name, records, bytes, digest).  Spark's output committer accepts
one attempt of each task into the manifest table; only files it lists are then renamed
to their final names, and readers follow the manifest of final names alone.  A task that
runs again writes under new names, so a lost executor leaves no half-written archive.

Files are reached through ``pyarrow.fs`` by the address of the shared folder, so it may be
any store that pyarrow opens.

Rows: a null payload is an empty one; a null id sorts first and is written as such; of
rows that repeat id and payload the first is the response (if none has a larger id) and
the others revisit it; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, remove, rows_of, run_folder, stored

REVISIT_FROM = 1000
# Compressed bytes at which a shard rolls to its next file.
ROLL_BYTES = 64 << 20
# Payload bytes of a shard, the most shards, and the keys picked for each of them at most.
SHARD_BYTES = 32 << 20
MOST_SHARDS = 20_000
KEYS_OF_SHARD = 50
# All records are dated alike: the date is part of the bytes and the tables hold none.
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "shard int, part int, temporary string, path string, records long, bytes long, sha1 string"
_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("part", pa.int32()),
                             ("temporary", pa.string()), ("path", pa.string()),
                             ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
_RECORD = ("record_id long, url string, record_type string, refers_to long, "
           "payload_digest string, payload_bytes long, payload binary")
_RECORD_ARROW = pa.schema([("record_id", pa.int64()), ("url", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()),
                           ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                           ("payload", pa.binary())])


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's address."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _urn(record_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{record_id}')}>"


def _base32(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _hex(base32: str) -> str:
    return base64.b32decode(base32.removeprefix("sha1:")).hex()


def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: str,
                 refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member, all headers generated from its parts."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"),
               ("WARC-Record-ID", _urn(record_id)), ("WARC-Date", DATE),
               ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block))),
               ("WARC-Payload-Digest", _base32(digest)),
               ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())),
               ("X-Record-Key", "" if record_id is None else str(record_id))]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=~%")
                        if url.isascii() and url.isprintable() else quote(url, safe=":/?#&=")))
        headers.append(("X-Target-Text", quote(url)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to)),
                    ("X-Refers-To-Key", "" if refers_to is None else str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


class _Shard:
    """The files of one task, written under temporary names."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.store, self.root = _store(folder)
        self.shard, self.roll_bytes, self.part = shard, roll_bytes, 0
        self.attempt = uuid.uuid4().hex
        self.file = None

    def write(self, member: bytes) -> tuple | None:
        """Add a record; the manifest row of the file if that filled it."""
        if self.file is None:
            self.name = f"_temporary/{self.attempt}-{self.part:05d}.warc.gz"
            self.store.create_dir(f"{self.root}/_temporary", recursive=True)
            self.file = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.size = self.records = 0
            self.sha1 = hashlib.sha1()
        self.file.write(member)
        self.sha1.update(member)
        self.size += len(member)
        self.records += 1
        return self.close() if self.size >= self.roll_bytes else None

    def close(self) -> tuple | None:
        if self.file is None:
            return None
        self.file.close()
        self.file = None
        row = (self.shard, self.part, self.name, f"shard-{self.shard:05d}-{self.part:05d}.warc.gz",
               self.records, self.size, self.sha1.hexdigest())
        self.part += 1
        return row


def shard_bounds(keys: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """First key (id, digest) of every shard but the first, in order, for keys (id, digest, bytes).

    At most about ``MOST_SHARDS`` * ``KEYS_OF_SHARD`` keys reach the driver, fewer for small
    tables; which ones is decided by their hashes, so it does not depend on partitions.
    """
    sums = keys.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    shards = min(MOST_SHARDS, max(1, -(-(sums.bytes or 0) // shard_bytes)))
    every = max(1, sums.n // (shards * KEYS_OF_SHARD))
    picked = (keys.filter(F.pmod(F.xxhash64("id", "digest"), F.lit(every)) == 0)
              .groupBy("id", "digest").agg(F.sum("bytes").alias("bytes")).collect())
    picked = sorted((r.id is not None, r.id or 0, r.digest, r.bytes) for r in picked)
    total, upto, bounds = sum(r[3] for r in picked), 0, []
    for *key, size in picked:
        # A key starts a new shard where the bytes before it pass the next equal part.
        if upto * shards >= total * (len(bounds) + 1) and upto < total:
            bounds.append(tuple(key))
        upto += size
    return bounds


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", roll_bytes: int = ROLL_BYTES,
                   revisit_from: int = REVISIT_FROM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write one record per row under ``folder``; the committed manifest (path, records, ...)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"),
                        F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    keys = keyed.filter(F.octet_length("payload") >= revisit_from).select("id", "digest")
    groups = stored(keys.groupBy("digest").agg(F.max("id").alias("response"),
                                               F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").drop("n"), f"{folder}/_groups")
    marks = (keys.join(groups, "digest").filter("not (id <=> response)").distinct()
             .select("id", F.lit(None).cast("string").alias("url"),
                     F.lit(None).cast("binary").alias("payload"), "digest",
                     F.col("response").alias("refers_to")))
    pieces = keyed.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks)
    bounds = shard_bounds(keyed.select("id", "digest", F.octet_length("payload").alias("bytes")), shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        places = [bisect_right(bounds, (False, 0, d) if pd.isna(i) else (True, int(i), d))
                  for i, d in zip(ids, digests)]
        return pd.Series(places, dtype="int32")

    # (shard, id, digest) first, a mark (no payload) before its rows.
    order = ["shard", "id", "digest", F.col("payload").isNotNull(), "url"]
    # Ids go as text, so that nulls do not turn them into floating-point numbers.
    ranged = (pieces.withColumn("shard", shard_of(F.col("id").cast("string"), F.col("digest")))
              .repartition(len(bounds) + 1, "shard").sortWithinPartitions(*order))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        out = Emitter(_MANIFEST_ARROW)
        place, target = None, None
        for number, doc, url, body, digest, refers_to in rows_of(
                batches, "shard", "id", "url", "payload", "digest", "refers_to"):
            if shard is None or shard.shard != number:
                if shard and (last := shard.close()):
                    out.add(last)
                shard = _Shard(folder, number, roll_bytes)
            if (doc, digest) != place:
                place, target = (doc, digest), None
                first = True
            if body is None:
                target, first = (refers_to,), False
                continue
            if not first and target is None:
                target = (doc,)
            revisit = target is not None and len(body) >= revisit_from
            full = shard.write(record_bytes(doc, url, body, digest,
                                            target[0] if revisit else None, revisit))
            first = False
            if full:
                out.add(full)
        if shard and (last := shard.close()):
            out.add(last)
        yield out.batch()

    manifest = stored(ranged.mapInArrow(write, _MANIFEST), f"{folder}/_manifest")

    def commit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for temporary, path in rows_of([batch], "temporary", "path"):
                # A second attempt finds the file renamed already.
                if store.get_file_info(f"{root}/{path}").type == fs.FileType.NotFound:
                    store.move(f"{root}/{temporary}", f"{root}/{path}")
            yield batch

    done = stored(_spread(manifest).mapInArrow(commit, _MANIFEST), f"{folder}/manifest")
    # Files of attempts that were lost are in no manifest.
    remove(pages.sparkSession, f"{folder}/_temporary")
    return done


def _spread(manifest: DataFrame) -> DataFrame:
    """A manifest with its files dealt to as many tasks."""
    return manifest.repartition(min(MOST_SHARDS, max(1, manifest.count())), "path")


def _members(stream) -> Iterator[bytes]:
    """Uncompressed records of an archive, one gzip member at a time."""
    inflate, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(1 << 20)):
        parts.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            yield b"".join(parts)
            data, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends inside a record")


def parse_record(raw: bytes) -> tuple:
    """(record_id, url, type, refers_to, payload_digest, payload_bytes, payload)."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = block[:int(headers["Content-Length"])]
    if _base32(hashlib.sha1(block).hexdigest()) != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = headers["WARC-Type"], _hex(headers["WARC-Payload-Digest"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload differs in {headers['WARC-Record-ID']}")
    key, refers = headers["X-Record-Key"], headers.get("X-Refers-To-Key")
    url = headers.get("X-Target-Text")
    return (int(key) if key else None, None if url is None else unquote(url), kind,
            int(refers) if refers else None, digest, size, payload if kind == "response" else None)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the committed files; digests are recomputed and compared on the way."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out = Emitter(_RECORD_ARROW)
        for path, records in rows_of(batches, "path", "records"):
            seen = 0
            with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                for raw in _members(stream):
                    out.add(parse_record(raw), len(raw))
                    seen += 1
                    if out.full:
                        yield out.batch()
            if seen != records:
                raise ValueError(f"{path} holds {seen} records, the manifest says {records}")
        yield out.batch()

    return _spread(manifest).mapInArrow(read, _RECORD)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read the records back."""
    folder = run_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)
