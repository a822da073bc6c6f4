"""WARC volumes and a Merkle fixity audit of their replicas.

Pages become WARC/1.1 resource records, in the order of (page_id, url, digest of html). Tasks take ranges of that order (and
of the row's number, so that no page, however often it is repeated, is one task's work) and write WARC files of VOLUME records,
a gzip member a record, to every replica's folder. A row of the manifest is a volume with its records' places; sums over
the tasks' totals give each record its number and offset in the whole.

The audit reads each replica's volumes, record by record, and hashes every record with its offset range into a leaf, FANOUT
leaves and their ranges into a node, and so on up to a volume's root. Every level is a saved table. Roots of two replicas
are compared, and only below nodes that differ are children compared, down to the records that differ: corrupt, or
missing from one replica. A level is a grouping by (volume, number div FANOUT), so no task sees more than FANOUT children
of a node.

A record's id is made of its page_id, url and digest, so rows that are equal in all three have one id. Blanks and line breaks
of a url are percent-encoded, so none can end its header. Nulls: a null page_id comes first, a null url or html is an empty
one. Repeated pages are records of their own. An empty table gives no volumes. Extra columns are not read. A file cut
short or lost reads as missing records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import Workspace, frugal

VOLUME = 512
FANOUT = 16
LEVELS = 3  # FANOUT ** LEVELS >= VOLUME
DATE = "2024-01-01T00:00:00Z"
#: What can't stand in a header's url.
ESCAPED = {" ": "%20", "\t": "%09", "\n": "%0A", "\r": "%0D"}


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, html): what every page's WARC record is made of."""
    url = F.coalesce("url", F.lit(""))
    for char, code in ESCAPED.items():
        url = F.replace(url, F.lit(char), F.lit(code))
    page = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return page.select("page_id", "url", F.unhex(F.sha2("html", 256)).alias("digest"), "html")


def _record() -> Column:
    """The WARC record of a row of `records`."""
    digest = F.lower(F.hex("digest"))
    name = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", digest), 256)
    parts = (F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("8"), F.substring(name, 14, 3)), F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), F.concat_ws("-", *parts),
        F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), digest,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"), F.col("html"), F.lit("\r\n\r\n"),
    )


PLACES = "number long, page_id long, start long, length long, record_sha256 string, stored_at long, stored_length long"
MANIFEST = f"part int, volume long, paths array<string>, n long, n_bytes long, records array<struct<{PLACES.replace(' long', ':long').replace(' string', ':string')}>>"


def write_volumes(table: DataFrame, folders: dict[str, Callable[[int | None, bytes], bytes] | None], volume_records: int = VOLUME) -> DataFrame:
    """One pass over `records` that writes each volume to every folder, a gzip member a record (.warc.gz): the manifest's rows.

    A folder's function, if any, changes records' stored bytes, for drills. Starts are those in the uncompressed volume, the
    stored ones in the files. Files have names of their own for each attempt, and only the returned ones count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        stores = [(f, *fs.FileSystem.from_uri(f)) for f in folders]
        part, seq = TaskContext.get().partitionId(), 0
        paths: list[str] = []
        files: list = []
        held: list[dict] = []
        start = at = 0

        def closed() -> pa.RecordBatch:
            for f in files:
                f.close()
            row = {"part": part, "volume": part << 32 | seq, "paths": list(paths), "n": len(held), "n_bytes": start, "records": list(held)}
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                for page_id, record in zip(rows["page_id"].to_pylist(), rows["record"].to_pylist(), strict=True):
                    if not held:
                        name = f"volume-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.warc.gz"
                        paths = [f"{f}/{name}" for f in folders]
                        for _, store, base in stores:
                            store.create_dir(base, recursive=True)
                        files = [store.open_output_stream(f"{base}/{name}", compression=None) for _, store, base in stores]
                    data = record.encode()
                    stored = gzip.compress(data, compresslevel=6, mtime=0)
                    for f, damage in zip(files, folders.values(), strict=True):
                        f.write(damage(page_id, stored) if damage else stored)
                    held.append({"number": len(held), "page_id": page_id, "start": start, "length": len(data), "record_sha256": hashlib.sha256(data).hexdigest(), "stored_at": at, "stored_length": len(stored)})
                    start, at = start + len(data), at + len(stored)
                    if len(held) >= volume_records:
                        yield closed()
                        held, start, at, seq = [], 0, 0, seq + 1
        if held:
            yield closed()

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("page_id", "url", "digest", "row")
    dealt = table.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.select("page_id", _record().alias("record")).mapInArrow(frugal(write), MANIFEST)


_PLACE = pa.struct([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in PLACES.split(", ")])
_MANIFEST = pa.schema([("part", pa.int32()), ("volume", pa.int64()), ("paths", pa.list_(pa.string())), ("n", pa.int64()), ("n_bytes", pa.int64()), ("records", pa.list_(_PLACE))])


def placed(manifest: DataFrame) -> DataFrame:
    """(volume, number, record_no, page_id, start, length, record_sha256): every record with its number and offset in the whole."""
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_tasks, task = Window.orderBy("part"), Window.partitionBy("part").orderBy("volume")
    parts = manifest.groupBy("part").agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))  # a row for each writing task
    parts = parts.select("part", before(all_tasks, "n").alias("n_before"), before(all_tasks, "n_bytes").alias("bytes_before"))
    places = manifest.select("part", "volume", (before(task, "n")).alias("n_here"), before(task, "n_bytes").alias("bytes_here"))
    places = places.join(parts.hint("merge"), "part").select("volume", (F.col("n_before") + F.col("n_here")).alias("first"), (F.col("bytes_before") + F.col("bytes_here")).alias("at"))
    each = manifest.select("volume", F.explode("records").alias("r")).join(places, "volume")
    return each.select("volume", "r.number", (F.col("first") + F.col("r.number")).alias("record_no"), "r.page_id", (F.col("at") + F.col("r.start")).alias("start"), "r.length", "r.record_sha256")


def leaves(manifest: DataFrame, *replicas: int) -> DataFrame:
    """(replica, volume, number, start, stop, hash): each record of those replicas, hashed as it is read; unreadable bytes hash as none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                store, name = fs.FileSystem.from_uri(row["path"])
                out: list[dict] = []
                try:
                    with store.open_input_stream(name, compression=None) as f:
                        for r in row["records"]:  # one record at a time
                            stored = f.read(r["stored_length"])
                            if len(stored) < r["stored_length"]:
                                break
                            try:
                                digest = hashlib.sha256(gzip.decompress(stored)).digest()
                            except (OSError, EOFError, zlib.error):
                                digest = b""
                            out.append({"replica": row["replica"], "volume": row["volume"], "number": r["number"], "start": r["start"], "stop": r["start"] + r["length"], "hash": digest})
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_pylist(out, schema=_LEAVES)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = F.transform("records", lambda r: F.struct(r["number"].alias("number"), r["start"].alias("start"), r["length"].alias("length"), r["stored_length"].alias("stored_length")))
    files = manifest.select("volume", F.explode(F.array(*(F.struct(F.lit(k).alias("replica"), F.element_at("paths", k + 1).alias("path")) for k in replicas))).alias("f"), places.alias("records"))
    files = files.select("volume", "f.replica", "f.path", "records").repartition(n, "path")
    return files.mapInArrow(frugal(read), "replica int, volume long, number long, start long, stop long, hash binary")


_LEAVES = pa.schema([("replica", pa.int32()), ("volume", pa.int64()), ("number", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.binary())])


def _node_hash(children: Column) -> Column:
    """Of an ordered array of (number, start, stop, hash)."""
    return F.unhex(F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["start"], c["stop"], F.hex(c["hash"]))), "|"), 256))


def tree(leaf: DataFrame, workspace: Workspace) -> list[DataFrame]:
    """Levels from the leaves to the roots, each saved, each (replica, volume, number, start, stop, hash); the last has one node a
    volume of a replica."""
    levels = [workspace.save("tree-0", leaf.withColumn("hash", _node_hash(F.array(F.struct("number", "start", "stop", "hash")))))]
    for k in range(1, LEVELS + 1):
        children = F.array_sort(F.collect_list(F.struct("number", "start", "stop", "hash")))
        nodes = levels[-1].groupBy("replica", "volume", F.floor(F.col("number") / FANOUT).alias("above")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), children.alias("children"))
        levels.append(workspace.save(f"tree-{k}", nodes.select("replica", "volume", F.col("above").alias("number"), "start", "stop", _node_hash(F.col("children")).alias("hash"))))
    return levels


def audit(leaf: DataFrame, workspace: Workspace, one: int = 0, other: int = 1) -> DataFrame:
    """(volume, number, status) of the records in which two replicas of `leaves` differ; status corrupt, missing or extra."""
    levels = tree(leaf.where(F.col("replica").isin(one, other)), workspace)
    wrong = None
    for k in range(LEVELS, -1, -1):
        x, y = (levels[k].where(F.col("replica") == r).select("volume", "number", F.col("hash").alias(name)) for r, name in ((one, "x"), (other, "y")))
        if wrong is not None:
            below = wrong.select("volume", F.col("number").alias("above"))
            x, y = (side.withColumn("above", F.floor(F.col("number") / FANOUT)).join(below, ["volume", "above"], "left_semi").drop("above") for side in (x, y))
        wrong = x.join(y, ["volume", "number"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
        wrong = workspace.save(f"wrong-{k}", wrong)
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    return wrong.select("volume", "number", status.alias("status"))
