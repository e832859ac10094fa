"""WARC archives with an externally merged capture index.

Write: each task writes its records to gzip-member WARC files.  Of records with
equal payloads the one with the largest id is the response, the others revisit
it.  Read back: one task a file reads every record, checks its digest, and sorts
the file's captures by URL key and time: a locally sorted run.  Merge: the runs'
captures are dealt to key ranges, and in each range a loser tree merges the k
runs' stretches; ranges are in order, so the whole is one globally ordered
capture history.

Scale.  Payloads are shuffled once, by digest, with nothing collected; a payload
that a third of all records share meets its response in a join that adaptive
execution splits (both sides are stored tables).  Files close after
``file_bytes`` or ``file_records``, so a run fits a task.  Ranges are cut on (URL key, time, id), so
captures of one URL spread over many.  Files have names of their own and count
only if the manifest that Spark commits names them: a task that runs twice
leaves no record twice.

Defined results: a null payload is empty; a null URL has an empty key; records
without a time get one from their id (a fixed epoch plus as many seconds);
payloads below ``min_payload`` bytes are always responses; repeated rows (equal
id and payload) are all written, alike; a null id stays null and no other record
refers to it.  An empty table has no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_store, shuffle_partitions, stage, stage_path

EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
CAPTURE = ("page_id long, urlkey string, captured string, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, file string, offset long, length long")
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
KEY = ["urlkey", "captured", "page_id", "file", "offset"]


@dataclass(frozen=True)
class Warc:
    min_payload: int = 0
    file_bytes: int = 256 << 20
    file_records: int = 200_000
    level: int = 6
    range_rows: int = 200_000


# -- records ------------------------------------------------------------------

def url_key(url: str | None) -> str:
    """Host labels reversed, then the path and query, lower case: captures of a site sort together."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host = u.hostname or ""
    except ValueError:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload but names its response and the payload's size."""
    when = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = b"" if refers_to is not None else payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {when}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha}",
            f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_records(src):
    """(offset, length, headers, body) of each gzip member of a binary stream, one record in memory."""
    offset, rest = 0, b""
    while True:
        if not rest:
            rest = src.read(1 << 16)
            if not rest:
                return
        member, parts, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            if not rest:
                rest = src.read(1 << 16)
                if not rest:
                    raise ValueError("archive cut short")
            parts.append(member.decompress(rest))
            used += len(rest) - len(member.unused_data)
            rest = member.unused_data
        raw = b"".join(parts)
        cut = raw.index(b"\r\n\r\n")
        head = dict(line.split(": ", 1) for line in raw[:cut].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        n = int(head["Content-Length"])
        body = raw[cut + 4:cut + 4 + n]
        if len(body) != n:
            raise ValueError("record cut short")
        yield offset, used, head, body
        offset += used


# -- loser tree -----------------------------------------------------------------

def merge_runs(runs: list):
    """Items of sorted iterables in order, by a loser tree: one comparison a level for each item.

    Ties go to the run that comes first.
    """
    k = len(runs)
    if not k:
        return
    its = [iter(r) for r in runs]
    end = object()
    head = [next(it, end) for it in its]

    def wins(a: int, b: int) -> bool:
        if a < 0 or b < 0:  # -1: a slot that no run has reached, it wins to be replaced
            return a < 0
        if head[b] is end:
            return head[a] is not end or a < b
        return head[a] is not end and (head[a], a) < (head[b], b)

    loser = [-1] * k

    def play(run: int) -> int:
        node = (run + k) // 2
        while node:
            if wins(loser[node], run):
                loser[node], run = run, loser[node]
            node //= 2
        return run

    champion = -1
    for run in range(k):
        top = play(run)
        if top >= 0:
            champion = top
    if k == 1:
        champion = 0
    while head[champion] is not end:
        yield head[champion]
        head[champion] = next(its[champion], end)
        champion = play(champion)


# -- operator ----------------------------------------------------------------------

def with_response(pages: DataFrame, how: Warc = Warc(), id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """(page_id, url, html, sha, refers_to): refers_to is the response's id, null for a response."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    src = src.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    last = stage(src.filter(F.octet_length("html") >= how.min_payload).groupBy(F.col("sha").alias("_sha"))
                 .agg(F.max("page_id").alias("_last")), "warc-last")
    return src.join(last.hint("merge"), F.col("sha") == F.col("_sha"), "left").select(
        "page_id", "url", "html", "sha", F.when(F.col("_last") != F.col("page_id"), F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, how: Warc = Warc(), **cols) -> DataFrame:
    """Writes WARC files under ``path``; returns their manifest (file, records), committed."""
    src = with_response(pages, how, **cols)

    def run(batches):
        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        done, out, name, n, size = [], None, "", 0, 0
        for batch in batches:
            html = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                page, url, sha, ref = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4))
                if out is None:
                    name, n, size = f"captures-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                sha = base64.b32encode(bytes.fromhex(sha)).decode()
                raw = gzip.compress(record(page, url, html[i].as_py(), sha, ref), how.level, mtime=0)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= how.file_bytes or n >= how.file_records:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], ["file", "records"])

    return stage(src.mapInArrow(run, "file string, records long"), "warc-manifest")


def page_of(urn: str) -> int | None:
    number = urn.rsplit(":", 1)[1].rstrip(">")
    return None if number == "None" else int(number)


def read_runs(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Every capture in the archives, each file's captures one sorted run numbered by ``seq``.

    A response whose payload does not give its digest stops the job.
    """

    def run(batches):
        store, root = open_store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as src:
                    for offset, length, head, body in read_records(src):
                        sha, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response" and digest(body) != sha:
                            raise ValueError(f"{name} at {offset}: payload and digest differ")
                        url, ref = head["WARC-Target-URI"], head.get("WARC-Refers-To")
                        rows.append((page_of(head["WARC-Record-ID"]), url_key(url), head["WARC-Date"], url,
                                     int(head["WARC-Payload-Length"]), sha, kind, page_of(ref) if ref else None,
                                     name, offset, length))
                rows.sort(key=lambda r: (r[1], r[2], -1 << 63 if r[0] is None else r[0], r[8], r[9]))
                for a in range(0, len(rows), 20_000):
                    yield table(rows[a:a + 20_000], a)

    def table(rows, a):
        cols = list(zip(*rows))
        kinds = [pa.int64() if c.endswith("long") else pa.string() for c in CAPTURE.split(", ")]
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds)],
                                           pa.array(range(a, a + len(rows)), pa.int64())], [*NAMES, "seq"])

    n = shuffle_partitions(spark)
    return stage(manifest.select("file").repartition(n, "file").mapInArrow(run, CAPTURE + ", seq long"), "warc-runs")


def merge_index(runs: DataFrame, how: Warc = Warc()) -> DataFrame:
    """The captures in global order: ``range_no``, then ``place`` in the range."""
    spark = runs.sparkSession
    ranges = max(shuffle_partitions(spark), -(-runs.count() // how.range_rows))
    dealt = (runs.repartitionByRange(ranges, *KEY).sortWithinPartitions("file", "seq")
             .withColumn("range_no", F.spark_partition_id()))
    key_at = [NAMES.index(c) for c in KEY]

    def run(batches):
        parts = list(batches)  # one range, bounded by range_rows
        if not parts:
            return
        held = pa.Table.from_batches(parts).combine_chunks()
        cols = [held.column(i).to_pylist() for i in key_at]
        cols[2] = [-1 << 63 if x is None else x for x in cols[2]]  # nulls first, as Spark deals them
        keys = list(zip(*cols, range(held.num_rows)))
        files = held.column(NAMES.index("file")).to_pylist()
        starts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
        order = [k[-1] for k in merge_runs([keys[a:b] for a, b in zip(starts, starts[1:])])]
        merged = held.take(pa.array(order)).drop_columns(["seq"]).append_column(
            "place", pa.array(range(len(order)), pa.int64()))
        yield from merged.combine_chunks().to_batches(max_chunksize=20_000)

    return dealt.mapInArrow(run, CAPTURE + ", range_no int, place long")


def capture_index(pages: DataFrame, how: Warc = Warc(), **cols) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder, reads them back, and merges their index."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    return merge_index(read_runs(spark, path, write_archives(pages, path, how, **cols)), how)
