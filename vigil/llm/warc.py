"""WARC archives of page captures, and a globally ordered index over them.

Writing: every capture is one WARC 1.0 record.  Its header block is built with
DataFrame expressions, and Spark's text writer puts the records into files:
the line separator is the two line ends that close a record, so a file is a
plain (gzip) WARC file and a lost task is written again by Spark's own commit
protocol.  Captures whose payload appeared before become ``revisit`` records
that refer to the response and carry no payload.

Reading: every archive is parsed by its Content-Length fields into index
entries that are sorted locally, one run per archive.  The runs are cut at
common key ranges, and the slices of a range are merged by a loser tree, so
that the ranges one after the other hold the capture histories in order.  A
range is cut by (URL key, time, id) and has a bounded number of entries, also
for a URL with very many captures.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import partitions_for
from vigil.plans.sizing import bounded_broadcast
from vigil.session import materialize, scratch_path, ship_package

#: Fixed values of RFC 4648 (base32) and of the WARC 1.0 format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRLF = "\r\n"

#: Raw payload bytes that one archive file holds on average at most.
ARCHIVE_BYTES = 32 << 20
#: Index entries merged by one task.
RANGE_ROWS = 20_000

INDEX_SCHEMA = ("url_key string, fetched string, record_id string, record_type string, refers_to string, "
                "payload_digest string, payload_bytes long, url string, archive string, offset long, length long, member long, "
                "intact boolean, run string, run_pos long")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's or binary's bytes."""
    digest = F.sha1(data.cast("binary"))
    chars = []
    for part in range(4):  # 40 bits are 8 digits
        bits = F.conv(F.substring(digest, 10 * part + 1, 10), 16, 10).cast("long")
        for k in range(7, -1, -1):
            five = F.shiftright(bits, 5 * k).bitwiseAND(F.lit(31).cast("long")).cast("int")
            chars.append(F.substring(F.lit(BASE32), five + 1, 1))
    return F.concat(*chars)


def _field(name: str, value: Column) -> Column:
    """A header line, null (and left out) for a null value; line ends inside are percent-coded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), safe)


def capture_records(captures: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """One row per capture with its WARC record as a string (without the closing line ends).

    ``captures``: ``capture_id`` (long), ``url``, ``fetched`` (14-digit time
    string), ``payload`` (string; null counts as empty); other columns are
    ignored.  Of captures whose payloads of at least ``min_revisit_bytes`` are
    equal, those with the smallest id are responses, the others revisits.  A
    null id is larger than any other.  Rows repeated with the smallest id are
    all responses.
    """
    c = captures.select("capture_id", "url", "fetched", F.coalesce("payload", F.lit("")).alias("payload"))
    c = c.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    same = c.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest") \
        .agg(F.min("capture_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1) \
        .select(F.col("digest").alias("__d"), "first_id")
    same = bounded_broadcast(materialize(same))
    c = c.join(same, (F.col("digest") == F.col("__d")) & (F.col("bytes") >= min_revisit_bytes), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("capture_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    urn = lambda i: F.concat(F.lit("<urn:capture:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    stamp = F.regexp_replace("fetched", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat_ws(
        CRLF, F.lit(VERSION), _field("WARC-Type", kind), _field("WARC-Record-ID", urn(F.col("capture_id"))),
        _field("WARC-Date", stamp), _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, _field("WARC-Refers-To", urn(F.col("first_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"), _field("Content-Length", length.cast("string")))
    return c.select("capture_id", "bytes", F.concat(head, F.lit(CRLF + CRLF), block).alias("record"))


def write_archives(captures: DataFrame, path: str, min_revisit_bytes: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write all captures as WARC files of about ``archive_bytes`` raw payload into ``path``."""
    size = captures.agg(F.avg(F.octet_length("payload"))).first()[0] or 0.0
    per_file = max(1, int(archive_bytes / (size + 600)))
    capture_records(captures, min_revisit_bytes).select("record").write.mode("errorifexists") \
        .option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, in lower case; empty without a host."""
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "")
    if not m or not m.group(1):
        return ""
    labels = m.group(1).lower().split(".")
    if labels[0] == "www" and len(labels) > 1:
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (m.group(2).lower() or "/")


class Stream:
    """Bytes of an archive, plain or gzip of any number of members, decompressed as far as they are asked for.

    Bytes before the record at hand are let go, so memory holds one record and not the
    file.  A member that is cut or damaged ends the stream; what came before it counts.
    """

    STEP = 1 << 20

    def __init__(self, content: bytes):
        self.content, self.packed = content, content[:2] == b"\x1f\x8b"
        self.read, self.buf, self.base = 0, bytearray(), 0
        self.zip = zlib.decompressobj(31) if self.packed else None
        #: (place in the stream, place in the file) where members begin.
        self.members = [(0, 0)]

    def _more(self) -> bool:
        """Reads on; False at the end."""
        if self.read >= len(self.content):
            return False
        part = self.content[self.read:self.read + self.STEP]
        self.read += len(part)
        if not self.packed:
            self.buf += part
            return True
        try:
            self.buf += self.zip.decompress(part)
            if self.zip.eof:  # the next member, if there is one, begins in what is left over
                self.read -= len(self.zip.unused_data)
                if self.content[self.read:self.read + 2] == b"\x1f\x8b":
                    self.zip = zlib.decompressobj(31)
                    self.members.append((self.base + len(self.buf), self.read))
                else:
                    self.read = len(self.content)
        except zlib.error:
            self.read = len(self.content)
        return True

    def upto(self, end: int) -> bool:
        """Whether the stream has ``end`` bytes."""
        while self.base + len(self.buf) < end:
            if not self._more():
                return False
        return True

    def find(self, what: bytes, at: int) -> int:
        """Place of the next ``what`` from ``at`` on, -1 if there is none."""
        begin = at - self.base
        while True:
            i = self.buf.find(what, begin)
            if i >= 0:
                return self.base + i
            begin = max(begin, len(self.buf) - len(what) + 1)
            if not self._more():
                return -1

    def take(self, a: int, b: int) -> bytes:
        return bytes(self.buf[a - self.base:b - self.base])

    def drop(self, at: int) -> None:
        del self.buf[:at - self.base]
        self.base = at
        while len(self.members) > 1 and self.members[1][0] <= at:
            self.members.pop(0)

    def member(self) -> int:
        """Place in the file of the member that the first byte held lies in."""
        return self.members[0][1]


def _header(block: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields (names in lower case; the first of a name counts); lines without a colon are passed over."""
    lines = block.decode("utf-8", "surrogateescape").split(CRLF)
    fields: dict[str, str] = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip(" \t"))
    return lines[0], fields


def _whole(x: str | None) -> int | None:
    return int(x) if x is not None and x.isascii() and x.isdigit() else None


def parse_archive(content: bytes, name: str) -> Iterator[tuple]:
    """Index entries of one archive's bytes, in file order.

    Records of other writers count too: any WARC/1.x version, field names in any case,
    records that are no HTTP message (their payload is the whole block) or whose HTTP
    header gives no length (it is the rest of the block), and records without a payload
    digest (it is computed).  A record that the file ends in is the last entry, not
    intact, if its header is whole, and is passed over if not.  Bytes that begin no
    record raise ValueError.
    """
    s, at = Stream(content), 0
    while s.upto(at + 1):
        s.drop(at)
        head_end = s.find(b"\r\n\r\n", at)
        if head_end < 0:
            if not s.take(at, at + 5).startswith(b"WARC/"[:min(5, s.base + len(s.buf) - at)]):
                raise ValueError(f"{name}: no record at {at}")
            return
        version, f = _header(s.take(at, head_end))
        length = _whole(f.get("content-length"))
        if not version.startswith("WARC/1.") or length is None:
            raise ValueError(f"{name}: no record at {at}")
        body, member = head_end + 4, s.member()
        complete = s.upto(body + length)
        block = s.take(body, body + length)
        http, said = 0, None
        if f.get("content-type", "").startswith("application/http") or block.startswith(b"HTTP/"):
            cut = block.find(b"\r\n\r\n")
            http = cut + 4 if cut >= 0 else len(block)
            said = _whole(_header(block[:max(cut, 0)])[1].get("content-length"))
        payload, kind = block[http:], f.get("warc-type", "")
        made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        digest = f.get("warc-payload-digest", f"sha1:{made}").removeprefix("sha1:")
        n_bytes = said if said is not None else len(payload)
        intact = complete and (kind == "revisit" or (n_bytes == len(payload) and digest == made))
        url = f.get("warc-target-uri")
        ident = lambda v: None if v is None else v.removeprefix("<urn:capture:").removesuffix(">")
        yield (url_key(url), re.sub(r"\D", "", f.get("warc-date", "")), ident(f.get("warc-record-id")), kind,
               ident(f.get("warc-refers-to")), digest, n_bytes, url, name, at, body + length - at, member, intact)
        if not complete:
            return
        at = body + length
        while s.upto(at + 2) and s.take(at, at + 2) == b"\r\n":  # the line ends that close a record
            at += 2


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each archive's entries, sorted: one run per archive."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = sorted(parse_archive(content, path.rsplit("/", 1)[-1]), key=entry_order)
            if rows:
                yield pd.DataFrame([(*r, path, i) for i, r in enumerate(rows)],
                                   columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def entry_order(r: Sequence) -> tuple:
    """Total order of index entries: URL key, time, id, then place."""
    return (r[0], r[1], r[2] or "", r[8], r[9])


class LoserTree:
    """Merge of k sorted sequences; each step replays one path of the tree of losers."""

    def __init__(self, runs: Sequence[Sequence], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _head(self, i: int):
        """(0, key) of a run's next item; (1,) once it is used up."""
        run, at = self.runs[i], self.at[i]
        return (0, self.key(run[at]), i) if at < len(run) else (1,)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.k and self.heads[self.winner][0] == 0:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self._head(w)
            node = (w + self.k) // 2
            while node:
                rival = self.losers[node]
                if self.heads[rival] < self.heads[w]:
                    self.losers[node], w = w, rival
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One key range: its runs' slices arrive run by run in order and leave merged."""
    runs: dict[str, list] = {}
    columns = None
    for pdf in batches:
        columns = list(pdf.columns)
        for r in pdf.itertuples(index=False, name=None):
            runs.setdefault(r[13], []).append(r)
    if runs:
        yield pd.DataFrame(list(LoserTree(list(runs.values()), entry_order)), columns=columns)


def read_index(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Globally ordered index of the archives under ``path``.

    Partitions are consecutive key ranges, each sorted by (url_key, fetched,
    record_id).  ``offset`` and ``length`` are places in the decompressed archive;
    ``member`` is the byte of the file at which to begin decompressing: the record's own
    gzip member in archives compressed record by record, 0 in those (such as this module
    writes) that are one member.  ``intact`` tells whether a response's payload has its
    digest.  An empty folder gives an empty index.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = materialize(files.mapInPandas(_runs, INDEX_SCHEMA))
    n = partitions_for(runs.count(), range_rows)
    cut = runs.repartitionByRange(n, "url_key", "fetched", "record_id").sortWithinPartitions("run", "run_pos")
    return cut.mapInPandas(_merge, INDEX_SCHEMA).drop("run", "run_pos")


def archive_and_index(captures: DataFrame, min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write all captures to archives in the shared folder, read them back, return the ordered index."""
    spark = captures.sparkSession
    path = path or scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(captures, path, min_revisit_bytes)
    return read_index(spark, path)
