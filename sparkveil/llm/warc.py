"""WARC archives: writing with revisit records, reading back, and an external merge of their indexes.

Pages become one archive file per task, each a gzip member per record, sorted by URL key and capture time: a capture run.
Of records with equal payloads of at least `least_bytes`, the one with the largest page_id is a response and the others
are revisits of it; smaller ones are all responses. Reading streams through each file, checks every digest, and yields
its index run. The runs are then dealt by range of (URL key, time, page_id), so that no range depends on another, and
in each range a loser tree merges what the runs have there: captures come out in the order of their histories.

A task that is run again writes a file of a new name; only files named by a finished task are read.

Defined results: null html is an empty payload and a response; a null URL has an empty key; a row with a null page_id is
captured at the base time and never what others refer to unless no equal payload has an id; repeated rows of the
largest page_id are all responses; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove, shared_dir, start_rows, table

LEAST_BYTES = 1000
#: 2026-01-01, in seconds; a page without a capture time was captured page_id seconds later, or the rest of that by
#: SECONDS, which keeps any id's date within four digits of a year (up to 2057). The id itself has its own field.
BASE_TIME = 1_767_225_600
SECONDS = 1_000_000_000
#: Index rows that one task merges, about.
RANGE_ROWS = 100_000
#: Revisits up to this number (some 20 MB) are sent to all tasks; more of them are joined by a shuffle of the pages.
BROADCAST_ROWS = 200_000
INDEX = "url_key string, captured_at long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, place long"


def url_key(url: Column) -> Column:
    """Host labels from the right, then the rest: `com,example,www)/path?query`."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^[^/?#]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"(?s)^[^/?#]*://[^/?#]*|#.*$", "")
    return F.when(url == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def roles(pages: DataFrame, least_bytes: int = LEAST_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pages with refers_to, which is null but for revisits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    narrow = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    kept = narrow.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("k")).where("k > 1 and keeper is not null")
    again = narrow.join(kept, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("keeper").alias("refers_to")).distinct()
    again = cut(again)
    if again.count() <= broadcast_rows:
        again = F.broadcast(again)
    joined = own.join(again, own["page_id"].eqNullSafe(again["_id"]) & (own["digest"] == again["_digest"]), "left")
    return joined.select("page_id", "url", "html", "refers_to")


def _header(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _date(seconds: int) -> str:
    import datetime

    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _seconds(date: str) -> int:
    import datetime

    return int(datetime.datetime.strptime(date, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.UTC).timestamp())


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(key: str, url: str | None, page_id: int | None, seconds: int, payload: bytes, refers_to: int | None) -> bytes:
    """One record, with the two line ends behind it."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = "".join(c for c in url or "" if c not in "\r\n")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", _date(seconds))]
    fields += [("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    # the key is kept, as a target without line ends may have another one
    fields += [("X-URL-Key", key.encode().hex()), ("X-Payload-Length", str(len(payload)))]
    block = http + payload
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        block = http
    return _header(fields, len(block)) + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out, records = None, 0
    for batch in batches:
        for key, seconds, page_id, url, html, refers_to in zip(*[c for c in batch.columns], strict=True):
            if out is None:
                store, at = fs.FileSystem.from_uri(folder)
                store.create_dir(at, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{at}/{name}", compression=None)
                about = b"software: sparkveil\r\nformat: WARC File Format 1.1\r\n"
                out.write(member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _date(BASE_TIME)), ("Content-Type", "application/warc-fields")], len(about)) + about + b"\r\n\r\n"))
            payload = (html.as_py() or "").encode()
            out.write(member(record(key.as_py(), url.as_py(), page_id.as_py(), seconds.as_py(), payload, refers_to.as_py())))
            records += 1
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], names=["file", "records"])


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write pages (page_id, url, html) into WARC files; file, records of each. Payloads stay in the tasks that read them.

    folder: a URI that driver and executors share.
    """
    at = F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(SECONDS)) + BASE_TIME
    placed = roles(pages, least_bytes, broadcast_rows).select(url_key(F.col("url")).alias("url_key"), at.alias("captured_at"), "page_id", "url", "html", "refers_to")
    return cut(placed.sortWithinPartitions("url_key", "captured_at", "page_id").mapInArrow(partial(_write_batches, folder=folder), "file string, records long"))


class Members:
    """A stream of bytes out of successive gzip members, in bounded memory."""

    def __init__(self, source, step: int = 1 << 18):
        self.source, self.step = source, step
        self.packed, self.plain, self.inflate = b"", bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.source.read(self.step)
            if not self.packed:
                return False
        self.plain += self.inflate.decompress(self.packed, self.step)
        if self.inflate.eof:
            self.packed, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        else:
            self.packed = self.inflate.unconsumed_tail
        return True

    def line(self) -> bytes:
        """The next line without its end; empty at the end of the stream too."""
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                return b""
        out = bytes(self.plain[:end])
        del self.plain[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise EOFError("the archive ends within a record")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a stream."""
    stream = Members(source)
    while (first := stream.line()).startswith(b"WARC/"):
        fields = {}
        while line := stream.line():
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = stream.take(int(fields["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record is not followed by two line ends")
        yield fields, block
    if first:
        raise ValueError("no record begins here")


def index_rows(source, run: str) -> Iterator[tuple]:
    """The index of one archive, every digest checked: rows of INDEX."""
    for place, (fields, block) in enumerate(records(source)):
        kind = fields["WARC-Type"]
        if kind not in ("response", "revisit"):
            continue
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(fields["X-Payload-Length"])
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
        refers_to = _number(fields["WARC-Refers-To"]) if kind == "revisit" else None
        yield bytes.fromhex(fields["X-URL-Key"]).decode(), _seconds(fields["WARC-Date"]), _number(fields["WARC-Record-ID"]), size, digest, kind, refers_to, run, place


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = [f.split()[0] for f in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _in_batches(rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held)
            held = []
    yield _batch(held)


def _read_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, at = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_stream(f"{at}/{name}", compression=None) as source:
                yield from _in_batches(index_rows(source, name))


def read(files: DataFrame, folder: str) -> DataFrame:
    """The index rows of WARC files, each file's in its order."""
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(partial(_read_batches, folder=folder), INDEX)


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, the root's winner is the next item."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.heads = [next(run, None) for run in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, len(runs))
        for k in range(len(runs)):
            self._play(k, first=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[b] is None or self.keys[a] is None:
            return self.keys[a] is not None or (self.keys[b] is None and a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int, first: bool = False) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                if first:  # wait for the opponent
                    self.losers[node] = winner
                    return
            elif self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs and self.heads[best := self.losers[0]] is not None:
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self.keys[best] = None if self.heads[best] is None else self.key(self.heads[best])
            self._play(best)


def history_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:  # rows come run by run, each run in order
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            runs.setdefault(row[7], []).append(row)
    yield from _in_batches(iter(LoserTree([iter(r) for r in runs.values()], history_key)))


def merge(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index rows of all runs with history_order, their gapless place in the order of URL key, time and page_id."""
    index = cut(index)
    ranges = max(1, -(-index.count() // range_rows), index.sparkSession.sparkContext.defaultParallelism)
    order = ["url_key", "captured_at", "page_id", "run", "place"]
    dealt = index.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions("run", "place")
    merged = cut(dealt.mapInArrow(_merge_batches, INDEX).withColumn("_at", F.monotonically_increasing_id()))
    return start_rows(merged, "history_order")[0]


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files, read back and put in the order of its history."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = write(table(spark, sf_dir, "pages"), folder)
    merged = merge(read(files, folder))  # written to the shared folder, so the archives may go
    remove(spark, folder)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "history_order")


ORACLE = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d,
    coalesce(url, '') as u, (coalesce(page_id, 0) % {SECONDS} + {SECONDS}) % {SECONDS} + {BASE_TIME} as captured_at from pages),
k as (select *, max(page_id) over (partition by d) as keeper from p),
r as (select *, n >= {LEAST_BYTES} and keeper is not null and page_id is distinct from keeper as again,
  case when u = '' then '' else array_to_string(list_reverse(string_split(lower(regexp_extract(u, '(?s)^[^/?#]*://([^/?#]*)', 1)), '.')), ',') || ')'
    || regexp_replace(u, '(?s)^[^/?#]*://[^/?#]*|#.*$', '', 'g') end as url_key from k)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when again then 'revisit' else 'response' end as record_type,
  case when again then keeper end as refers_to, url_key, captured_at::bigint as captured_at,
  row_number() over (order by url_key collate "C", captured_at, page_id nulls first) - 1 as history_order from r"""
