"""Web archives: records written and read back, and their index in global order.

Spark writes a record per page, as text files whose line separator is the blank lines that end a WARC record.
Every archive file that is read back gives a run of index entries sorted by URL key and time. The runs are stored
and dealt to ranges of keys, and each range merges its pieces of runs with a loser tree (Knuth, vol. 3, 5.4.1).
"""

from __future__ import annotations

import hashlib
from itertools import batched, groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from realpay.llm import urls
from realpay.llm.tables import new_path, shuffle_partitions, stored
from realpay.llm.textbytes import column_bytes

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: Records of one archive file, at most; a file is read by one task, as a stream.
FILE_RECORDS = 2_000
#: Index entries that one range merges, about; a task holds them as Arrow columns.
RANGE_ROWS = 100_000
#: Entries of a run whose keys are unpacked at once.
STEP_ROWS = 256
#: Payload bytes of read records that are handed on at once, about.
OUT_BYTES = 8 << 20
#: Fixed values of the format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"
#: 2024-01-01, the time of page 0; page n is taken n seconds later, where no time is given.
EPOCH = 1_704_067_200


def capture_time(page_id):
    """A time for pages that come without one, from their id."""
    return F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(10**9))


def _utc(seconds, form: str):
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), form)


def records(pages: DataFrame) -> DataFrame:
    """``record``: the text of a WARC record for each row of ``pages`` (``page_id, url, html``).

    Of rows with equal payloads of LEAST_BYTES or more, those with the least page_id are responses, the others
    revisits without payload that refer to it. Rows without page_id are responses.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("digest"))
    same = rows.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(stored(same.where("n > 1").select("digest", "first"), "firsts"), "digest", "left")
    again = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{RECORD_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), _utc(capture_time(F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.concat(F.lit(f"WARC-Refers-To: <{RECORD_ID}"), F.col("first"), F.lit(f">{CRLF}WARC-Profile: {REVISIT_PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length),
    ]  # null lines (no url, no revisit) are left out
    head = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2))
    return rows.select(F.concat(head, http, F.when(again, "").otherwise(F.col("payload"))).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write :func:`records` as archive files, compressed as a whole, in the folder ``path``."""
    records(pages).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes, whole: bool = True):
    """(offset, length, headers, block) of each record of an archive.

    Without ``whole``, ``data`` may end inside a record, which is left out.
    """
    at = 0
    while at < len(data):
        body = data.find(b"\r\n\r\n", at) + 4
        if body < 4 and not whole:
            return
        head = data[at : max(body, at + 4) - 4].decode().split("\r\n")
        if body < 4 or not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in head[1:])
        end = body + int(fields["Content-Length"])
        if end + 4 > len(data) and not whole:
            return
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield at, end + 4 - at, fields, data[body:end]
        at = end + 4


def _lines(batches):
    """(file, whole lines as bytes). A file is named on the first line of each record, so on its own first line too."""
    file = None
    for batch in batches:
        low = 0
        for at in np.flatnonzero(batch.column("file").is_valid()).tolist():
            name = batch.column("file")[at].as_py()
            if name != file:
                if at > low:
                    yield file, _joined(batch.column("value").slice(low, at - low))
                low, file = at, name
        yield file, _joined(batch.column("value").slice(low))


def _joined(lines: pa.Array) -> bytes:
    data, offsets = column_bytes(lines)
    return np.insert(data, offsets[1:], 10).tobytes()


def _records(lines):
    """(file, offset, length, headers, block) of each record of ``lines``. Holds the lines of one step and one record."""
    for file, own in groupby(lines, key=itemgetter(0)):
        parts, held, need, at = [], 0, 0, 0
        for _, piece in own:
            parts.append(piece)
            held += len(piece)
            if held < need:
                continue
            data, used = b"".join(parts), 0
            for offset, length, fields, block in parse(data, whole=False):
                yield file, at + offset, length, fields, block
                used = offset + length
            parts, held, at = [data[used:]], len(data) - used, at + used
            need = 2 * held  # a long record is joined a few times only
        for offset, length, fields, block in parse(b"".join(parts)):
            yield file, at + offset, length, fields, block


def _page(reference: str | None) -> int | None:
    number = (reference or "").strip("<>").removeprefix(RECORD_ID)
    return int(number) if number else None


_FIELDS = [("file", pa.string()), ("position", pa.int64()), ("record_bytes", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
_SQL = ", ".join(f"{n} {({pa.int64(): 'long', pa.binary(): 'binary'}).get(t, 'string')}" for n, t in _FIELDS)


def _read(batches, with_payload: bool):
    out, held = [], 0
    for file, offset, length, fields, block in _records(_lines(batches)):
        head, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{file}: the payload at byte {offset} is not what its digest says")
        payload = payload if with_payload and kind == "response" else None
        out.append((file, offset, length, _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Date"],
                    kind, _page(fields.get("WARC-Refers-To")), size, digest, payload))
        held += len(payload or b"")
        if len(out) == 500 or held >= OUT_BYTES:
            yield _batch(out)
            out, held = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all compressed archive files in ``path``: where each stands, its fields, and a response's payload.

    The place counts bytes of the uncompressed file. Length and digest of every response are checked. A file is
    read line by line, so it may be of any size; a task holds its longest record.
    """
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*.gz").text(path)
    named = F.when(F.col("value") == VERSION + "\r", F.col("_metadata.file_path"))
    return lines.select("value", named.alias("file")).mapInArrow(lambda batches: _read(batches, with_payload), _SQL)


class LoserTree:
    """Merges sorted runs of (key, row): each inner node keeps the loser of the match below it, the winner goes up."""

    def __init__(self, runs: list):
        self.runs, self.k = [iter(run) for run in runs], len(runs)
        self.heads = [next(run, None) for run in self.runs]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        one, other = self.heads[a], self.heads[b]
        return other is None or one is not None and (one[0], a) < (other[0], b)

    def _play(self, node: int) -> int:
        """Play the matches below ``node`` and its own; nodes from k on are the runs."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        return winner

    def __iter__(self):
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head[1]
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._wins(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


_ENTRY = ["urlkey", "captured", "page_id", "file", "position", "record_bytes", "record_type", "refers_to", "payload_bytes", "payload_digest"]


def _entries(table: pa.Table, low: int, high: int):
    """(key, row) of the rows from ``low`` to ``high``, a step unpacked at a time."""
    for at in range(low, high, STEP_ROWS):
        step = table.slice(at, min(STEP_ROWS, high - at))
        for row, (urlkey, captured, page, file, position) in enumerate(zip(*(step.column(c).to_pylist() for c in _ENTRY[:5])), at):
            yield (urlkey, captured, page is not None, page or 0, file, position), row


def _merge(batches):
    """Merge what arrives of the runs for one range of keys. The pieces come one after another, each in its order; a new
    one begins where the order breaks."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    del batches
    starts, last = [], None
    for key, row in _entries(table, 0, len(table)):
        if last is None or key < last:
            starts.append(row)
        last = key
    runs = [_entries(table, low, high) for low, high in pairwise([*starts, len(table)])]
    for rows in batched(LoserTree(runs), 2_000):
        yield from table.take(rows).combine_chunks().to_batches()


def index(archived: DataFrame) -> DataFrame:
    """An entry for each record of :func:`read_archives`, in the order of URL key, time and page over all partitions.

    The entries of each file are sorted first and stored; these runs are then dealt to ranges of about RANGE_ROWS
    entries, in their order, and merged. Key, time and page together set the ranges, so one much captured key is split as well.
    """
    captured = F.regexp_replace("captured", "[^0-9]", "")
    entries = archived.select(urls.sort_key(F.col("url")).alias("urlkey"), captured.alias("captured"), *_ENTRY[2:])
    runs = stored(entries.sortWithinPartitions("file", "urlkey", "captured", "page_id", "position"), "runs")
    ranges = max(shuffle_partitions(archived.sparkSession), runs.count() // RANGE_ROWS)
    return runs.repartitionByRange(ranges, "urlkey", "captured", "page_id", "file", "position").mapInArrow(_merge, runs.schema)


def write_index(entries: DataFrame, path: str) -> None:
    """Write :func:`index` as lines of text; its files, in the order of their names, are in global order."""
    entries.select(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _ENTRY))).write.text(path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) to archives in the shared folder, read them back, index them.

    Returns per row ``page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, captured`` in the
    order of the index. A null html is an empty payload, a null url has the key of an empty host. Rows that repeat
    the least page_id of their payload are all responses; a row without page_id is a response. Other columns
    are ignored; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    entries = index(read_archives(spark, path, with_payload=False))
    return entries.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")
