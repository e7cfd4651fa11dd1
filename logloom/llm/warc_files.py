"""WARC archives: a deterministic sharded writer, and a reader.

Writing:

1. every page gets the SHA-1 of its payload (the html in UTF-8). Of pages with equal
   payloads of `LEAST_BYTES` or more, the one with the greatest id (then url) is the
   `response`; the others are `revisit` records that refer to it. This is worked out
   on ids, urls and digests alone, so a payload is shuffled once only;
2. records are sorted by (page_id, url) over ranges whose cuts come from a sample
   dealt by a hash of the key, so the same rows and number of ranges always give the
   same files, byte for byte, wherever tasks run;
3. a task writes its range, one gzip member for each record, and begins a new file
   when the compressed size has reached `most_bytes`. Headers (ids, dates, lengths,
   payload and block digests) are made anew from the page. A file is written under a
   temporary name of the task attempt, and its row in the manifest is the task's
   output: a lost or repeated task leaves a temporary file that no row names;
4. once the manifest is written, files move to their final names (moved ones are
   left alone, so this may be repeated), and the manifest takes its own name last:
   a folder with `manifest.parquet` is whole, one without is none.

Reading streams each file of the manifest, member by member, checks both digests and
the lengths, and gives back a row for each record.

Null html counts as empty. Null ids come before all others and are read back as null;
a null url counts as empty and is written as `urn:page:<id>`. Rows that repeat an id
get record ids of their own; of repeated rows with equal payloads long enough, one is
the response (of the greatest id's rows, the first). Rows equal in id and url are
sorted by digest and stand in one range. Other columns are ignored. An empty table
gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, partitions, range_of, shared_dir

LEAST_BYTES, MOST_BYTES, SAMPLED = 1000, 64 << 20, 64
NO_ID = -(1 << 63)  # stands for a null id
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
FILES = "range int, seq int, name string, written string, n_records long, bytes long, sha1 string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
UNSAFE = re.compile(rb"[^\x21\x23-\x3b\x3d\x3f-\x5b\x5d\x5f\x61-\x7a\x7e]")


# ------------------------------------------------------------------ records


def _base32(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record_id(page: int, url: str, digest: str, k: int) -> str:
    """The same for the same page, whatever is written with it. k: its place among equal rows."""
    own = hashlib.sha1(f"{url}\n{digest}".encode()).hexdigest()[:16]
    return f"<urn:page:{'null' if page == NO_ID else page}:{own}:{k}>"


def record(kind: str, head: dict[str, str], block: bytes) -> bytes:
    """One record, compressed as a member of its own."""
    fields = {"WARC-Type": kind, **head, "WARC-Block-Digest": _base32(hashlib.sha1(block).hexdigest()), "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)  # its time stamp is 0
    return squeeze.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page: int, url: str, digest: str, payload: bytes, k: int, target: tuple[int, str] | None, date: str) -> bytes:
    """target: (id, url) of the response of equal payload, if this is a revisit."""
    uri = UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()).decode() or f"urn:page:{'null' if page == NO_ID else page}"
    head = {"WARC-Record-ID": record_id(page, url, digest, k), "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": _base32(digest), "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    block = HTTP % len(payload)
    if target is None:
        return record("response", head, block + payload)
    return record("revisit", head | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(*target, digest, 0)}, block)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; raises where a length or digest is wrong."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:-4]
    if version != "WARC/1.1" or rest[-4:] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]) or _base32(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"]:
        raise OSError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return fields, block


def members(stream):
    """Offset and content of each gzip member of a file."""
    offset, data, unzip, out = 0, b"", None, []
    while data or (data := stream.read(1 << 20)):
        if unzip is None:
            unzip = zlib.decompressobj(31)
            start = offset
        out.append(unzip.decompress(data))
        offset += len(data) - len(unzip.unused_data)
        data = unzip.unused_data
        if unzip.eof:
            yield start, b"".join(out)
            unzip, out = None, []
    if unzip is not None:
        raise OSError("the file ends within a record")


# ------------------------------------------------------------------ writing


class _File:
    """A file under its temporary name."""

    def __init__(self, fs, root: str, part: int, seq: int, date: str):
        task = TaskContext.get()
        self.part, self.seq, self.name = part, seq, f"pages-{part:06d}-{seq:05d}.warc.gz"
        self.written = f"_temporary/{self.name}.{task.taskAttemptId()}-{uuid.uuid4().hex}"
        self.out, self.size, self.records, self.sha1 = fs.open_output_stream(f"{root}/{self.written}", compression=None), 0, 0, hashlib.sha1()
        info = f"software: logloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
        self.put(record("warcinfo", {"WARC-Record-ID": f"<urn:file:{self.name}>", "WARC-Date": date, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, info))
        self.records = 0

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha1.update(member)
        self.size, self.records = self.size + len(member), self.records + 1

    def row(self) -> pa.RecordBatch:
        self.out.close()
        columns = [[x] for x in (self.part, self.seq, self.name, self.written, self.records, self.size, self.sha1.hexdigest())]
        types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in FILES.split(", ")])


def _ordered(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages (kind 1), each after what is known of its payload's response (kind 0), by ranges."""
    n = partitions(pages.sparkSession)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")]
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(*key, payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    groups = long.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("target"), F.sum("n").alias("all")).where("`all` > 1").drop("all")
    told = long.drop("n").join(groups, "digest").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", F.lit(0).alias("kind"), "target")
    both = told.unionByName(rows.withColumns({"kind": F.lit(1), "target": F.lit(None).cast("struct<page_id:long,url:string>")}))
    keys = pages.select(*key)
    every = max(1, keys.count() // (n * SAMPLED))
    sample = keys.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0).distinct().orderBy("page_id", "url").collect()  # about SAMPLED for each range
    cuts = sorted({(r.page_id, r.url) for r in (sample[i * len(sample) // n] for i in range(1, n))}) if sample else []
    cuts = [F.struct(F.lit(p).cast("long").alias("page_id"), F.lit(u).alias("url")) for p, u in cuts]
    dealt = both.withColumn("range", range_of(F.struct("page_id", "url"), cuts)).repartitionById(n, F.col("range"))
    return dealt.sortWithinPartitions("range", "page_id", "url", "digest", "kind")


def write_archive(pages: DataFrame, folder: str, most_bytes: int = MOST_BYTES, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archive of `pages` in `folder`, a URI that all machines reach; its manifest, FILES."""
    spark = pages.sparkSession

    def rows(batch):
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("range", "page_id", "url", "digest", "kind", "payload", "target")), strict=True)

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        file, told, last, k = None, None, None, 0
        for batch in batches:
            for part, page, url, digest, kind, payload, target in rows(batch):
                if not kind:
                    told = (page, url, digest, (target["page_id"], target["url"]))
                    continue
                k, last = (k + 1 if last == (page, url, digest) else 0), (page, url, digest)
                first = told[3] if told is not None and told[:3] == last else None
                if file is not None and (file.part != part or file.size >= most_bytes):
                    yield file.row()
                    file = _File(fs, root, part, file.seq + 1 if file.part == part else 0, date)
                elif file is None:
                    file = _File(fs, root, part, 0, date)
                file.put(page_record(page, url, digest, payload, k, None if first == (page, url) and k == 0 else first, date))
        if file is not None:
            yield file.row()

    def moved(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for written, name, size in zip(*(batch.column(c).to_pylist() for c in ("written", "name", "bytes")), strict=True):
                there = fs.get_file_info(f"{root}/{name}")
                if there.type != pafs.FileType.File or there.size != size:
                    fs.move(f"{root}/{written}", f"{root}/{name}")
            yield batch

    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(f"{folder}/manifest.parquet")):
        raise OSError(f"{folder} has a manifest already")
    draft = f"{folder}/_temporary/manifest-{uuid.uuid4().hex}"
    _ordered(pages, id_col, url_col, html_col).mapInArrow(write, FILES).write.parquet(draft)
    files = spark.read.schema(FILES).parquet(draft)
    files.repartition(partitions(spark), "name").mapInArrow(moved, FILES).agg(F.count("*")).collect()
    if not fs.rename(path(draft), path(f"{folder}/manifest.parquet")):
        raise OSError(f"the manifest of {folder} could not take its name")
    fs.delete(path(f"{folder}/_temporary"), True)
    return manifest(spark, folder)


# ------------------------------------------------------------------ reading


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """FILES of a whole archive, in order of their names."""
    return spark.read.schema(FILES).parquet(f"{folder}/manifest.parquet")


def _page(urn: str | None) -> int | None:
    page = urn.split(":")[2] if urn else "null"
    return None if page == "null" else int(page)


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS of every page in the archive; `payload` is null for revisits, and where `payloads` is false."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def rows(fs, root: str, name: str, size: int, n_records: int):
        n = 0
        if fs.get_file_info(f"{root}/{name}").size != size:
            raise OSError(f"{name} does not have the size that the manifest tells")
        with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
            for offset, member in members(stream):
                fields, block = parsed(member)
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                n += 1
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                length, digest = int(fields["X-Payload-Length"]), base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise OSError(f"payload of {fields['WARC-Record-ID']} is damaged")
                yield _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload if payloads else None, length, digest, kind, _page(fields.get("WARC-Refers-To")), name, offset
        if n != n_records:
            raise OSError(f"{name} has {n} records, the manifest tells {n_records}")

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, n_records in zip(*(batch.column(c).to_pylist() for c in ("name", "bytes", "n_records")), strict=True):
                out, held = [], 0
                for row in rows(fs, root, name, size, n_records):
                    out.append(row)
                    held += len(row[2] or b"") + 200
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    files = manifest(spark, folder)
    return files.repartition(partitions(spark), "name").mapInArrow(read, RECORDS)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """What the archive of `pages` tells of each: its size, digest, kind of record, and the page it refers to."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder)
    return read_archive(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
