"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

1. Each text's set of word shingles gets a sketch of BANDS * rows coordinates (`shingles.fast_sketch`) and a band key
   for every `rows` coordinates. Texts of equal sets (by a 128-bit hash) are one node from here on.
2. Nodes that share a band key form a bucket. Buckets of equal members count once. `rows` is the largest for which
   a pair at the threshold shares no band with a probability of at most MISS.
3. A bucket never gives all its pairs. The member nearest to the majority of its sketches stands as hub for the members
   that it resembles (an estimate not more than SIGMAS deviations below the threshold), then the next for those left,
   until all are covered. A bucket of more than BLOCK members is covered block by block, then the hubs of its blocks
   are, and so on: the work grows with the bucket, whatever its size. These pairs are confirmed on the full sets, and
   confirmed links make components.
4. Buckets that still hold different components are compared on the full sets, tile by tile, and give only the links
   that join components. So no link between texts of one bucket is lost. Members meet in pairs of blocks of at most
   BLOCK_HASHES hashes; blocks of one component don't meet, nor do those whose sizes can't reach the threshold. A group's
   id is its least doc_id.

Step 4 is linear in a bucket of one large component and few others. In one of many components, none like another, it has to
compare them all: sketches alone can't show that nothing is lost.

Sets are compared as 64-bit hashes of shingles. Nulls: a null text is an empty one and is linked with nothing; rows
with a null doc_id join groups, but name none (component_id is null if no member has an id; kept only then). Repeated
rows are equal sets. An empty table gives an empty result. `near_duplicates` reads no further columns; `one_of_each_group`
keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import HOT_ROWS, Workspace, frugal, join_split, release_memory, text_or_empty, unused
from tracelake.llm.components import components
from tracelake.llm.shingles import fast_sketch, mix, set_digest, shingle_set

BANDS = 40
MISS = 1e-6
SIGMAS = 5.0
#: Coordinates whose low byte is kept for estimates.
BYTES = 256
BLOCK = 2_048
#: Hashes in the sets of a block in step 4.
BLOCK_HASHES = 500_000
#: Members of a block after which a worker gives memory back.
LARGE = 500
#: Sets compared at a time, and hashes in the matrices that compare them.
TILE, COLUMNS = 512, 4_096
SKETCHES = "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, bytes binary"


def rows_per_band(threshold: float, bands: int = BANDS, miss: float = MISS) -> int:
    rows = 1
    while rows < 500 // bands and (1 - threshold ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def sketches(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    rows = rows_per_band(threshold)
    size = max(BANDS * rows, BYTES)
    numbers = mix(np.arange(BANDS, dtype=np.uint64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[], [], [], []]
                for text in part["text"].to_pylist():
                    hashes = shingle_set(text, width)
                    made = (len(hashes), None, None, None)
                    if len(hashes):
                        sketch = fast_sketch(hashes, size)
                        keys = numbers
                        for column in sketch[: BANDS * rows].reshape(BANDS, rows).T:
                            keys = mix(keys ^ column)
                        made = (len(hashes), set_digest(hashes), keys.view(np.int64), sketch[:BYTES].astype(np.uint8).tobytes())
                    for column, value in zip(out, made, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()), strict=True))], names=["doc_id", "text_key", "n_shingles", "digest", "bands", "bytes"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_or_empty().alias("text")).mapInArrow(frugal(work), SKETCHES)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(digest, hashes) of each row of (text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t, width) for t in batch["text"].slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "hashes"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(frugal(work), "digest binary, hashes array<long>")


def _cover(members: DataFrame, low: float, cover: float) -> DataFrame:
    """(key, hub, member) from (key, block, node, bytes): hubs that resemble all of a block's members, and each hub with itself."""

    def pairs(bucket: pd.DataFrame) -> pd.DataFrame:
        hubs, others = [], []
        bucket = bucket.sort_values("node")
        ids, part = bucket["node"].to_numpy(), np.frombuffer(b"".join(bucket["bytes"]), dtype=np.uint8).reshape(len(bucket), -1)
        width, left = part.shape[1], np.arange(len(bucket))
        while len(left):
            rows, hub = part[left], 0
            if len(left) > 2:
                votes = np.bincount((rows + 256 * np.arange(width, dtype=np.uint16)).ravel(), minlength=256 * width).reshape(width, 256).argmax(axis=1)
                hub = int((rows == votes.astype(np.uint8)).sum(axis=1).argmax())
            like = (rows == rows[hub]).sum(axis=1) / width
            near = left[like >= low]  # the hub itself among them
            others.append(ids[near])
            hubs.append(np.full(len(near), ids[left[hub]]))
            left = left[like < cover]
        out = pd.DataFrame({"key": bucket["key"].iloc[0], "hub": np.concatenate(hubs), "member": np.concatenate(others)})
        if len(bucket) > LARGE:
            del bucket, ids, part, left, rows, hubs, others
            release_memory()
        return out

    return members.groupBy("key", "block").applyInPandas(pairs, "key long, hub long, member long")


def _covering_pairs(members: DataFrame, nodes: DataFrame, low: float, cover: float, workspace: Workspace, block: int) -> DataFrame:
    """Distinct (hub, member) pairs to be verified, from the buckets' members (key, n, node)."""
    level, found, turn = members, None, 0
    while True:
        blocks = F.ceil(F.col("n") / block)
        dealt = level.withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), blocks).cast("int")).join(nodes.select("node", "bytes"), "node")
        dealt = dealt.select("key", "block", "node", "bytes").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "block")
        stars = workspace.save(f"stars-{turn}", _cover(dealt, low, cover))
        pairs = stars.where("hub <> member").select("hub", "member")
        found = pairs if found is None else found.union(pairs)
        large = level.where(F.col("n") > block).select("key", "n").distinct()
        if large.isEmpty():
            break
        # the hubs of buckets that were covered in several blocks make a bucket again, unless blocks hardly shrank
        hubs = stars.select("key", F.col("hub").alias("node")).join(large, "key").distinct()
        counts = hubs.groupBy("key", "n").agg(F.count("*").alias("left")).where("left > 1 AND left < 0.9 * n").select("key", F.col("left").alias("n"))
        turn += 1
        level = workspace.save(f"hubs-{turn}", hubs.select("key", "node").join(counts, "key").select("key", "n", "node"))
        if level.isEmpty():
            break
    # one direction for each pair, whichever bucket it comes from
    found = found.groupBy(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).agg(F.min("hub").alias("hub"))
    return found.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))


def link_components(sets: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between different components, one for each two that become one, found on the full sets.

    Sets in tiles of TILE are compared by multiplying 0-1 matrices over the hashes that at least two sets hold.
    """
    sizes = np.array(list(map(len, sets)))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(code, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    codes = [number[c[shared[c]]] for c in np.split(code, np.cumsum(sizes)[:-1])]
    parent = {int(c): int(c) for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    starts = range(0, len(sets), TILE)
    for s in starts:
        mine = np.unique(np.concatenate(codes[s : s + TILE]))
        for t in starts:
            if t < s or len({root(int(c)) for c in component[[*range(s, min(s + TILE, len(sets))), *range(t, min(t + TILE, len(sets)))]]}) < 2:
                continue
            common = np.zeros((len(codes[s : s + TILE]), len(codes[t : t + TILE])))
            for at in range(0, len(mine), COLUMNS):
                columns = mine[at : at + COLUMNS]
                tiles = []
                for first in (s, t):
                    tile = np.zeros((len(codes[first : first + TILE]), len(columns)), dtype=np.float32)
                    for k, c in enumerate(codes[first : first + TILE]):
                        place = np.searchsorted(columns, c)
                        inside = place < len(columns)
                        inside[inside] = columns[place[inside]] == c[inside]
                        tile[k, place[inside]] = 1
                    tiles.append(tile)
                common += tiles[0] @ tiles[1].T
            total = sizes[s : s + TILE, None] + sizes[None, t : t + TILE]
            for x, y in zip(*np.nonzero(100 * common >= percent * (total - common)), strict=True):
                a, b = root(int(component[s + x])), root(int(component[t + y]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((s + int(x), t + int(y)))
    return links


def _meetings(placed: DataFrame, percent: int, block: int, block_hashes: int) -> DataFrame:
    """(key, i, j, node, component): pairs of blocks i <= j in which all members of a bucket that may be linked, and are of
    different components, meet. placed: (key, node, component, size) of the buckets with several components."""
    width = -math.log(percent / 100) * 1.001 if percent < 100 else 1e-3
    sized = placed.withColumn("class", F.floor(F.log("size") / width).cast("int"))  # linked sets are of one class or two neighbouring ones
    room = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(float(block_hashes)) / F.exp((F.col("class") + 1) * width)))).cast("long")
    each = sized.groupBy("key", "class", "component").agg(F.count("*").alias("n")).withColumn("room", room).withColumn("large", F.col("n") > F.col("room"))
    small = each.where(~F.col("large")).groupBy("key", "class").agg(F.sum("n").alias("small"))
    each = each.join(small, ["key", "class"], "left").withColumn("owner", F.when(F.col("large"), F.col("component")))
    parts = F.ceil(F.when(F.col("large"), F.col("n")).otherwise(F.col("small")) / F.col("room"))
    each = each.select("key", "class", "component", "owner", parts.alias("parts"))
    at = F.pmod(F.xxhash64(F.when(F.col("owner").isNull(), F.col("component")).otherwise(F.col("node"))), F.col("parts"))
    dealt = sized.join(each, ["key", "class", "component"]).withColumn("block", F.xxhash64("class", F.coalesce("owner", F.lit(-1)), at)).select("key", "class", "owner", "block", "node", "component")
    blocks = dealt.select("key", "class", "owner", "block").distinct()
    x, y = blocks.toDF("key", "c", "o", "i"), blocks.toDF("key", "d", "p", "j")
    meet = x.join(y, "key").where("(c = d AND i <= j OR c + 1 = d) AND NOT coalesce(o = p, false)").select("key", "i", "j")
    here = dealt.select("key", "block", "node", "component")
    left = meet.join(here.withColumnRenamed("block", "i"), ["key", "i"]).select("key", "i", "j", "node", "component")
    right = meet.where("i <> j").join(here.withColumnRenamed("block", "j"), ["key", "j"]).select("key", "i", "j", "node", "component")
    return left.union(right)


def _rest(members: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join different components of two blocks, from (key, i, j, node, component, hashes)."""

    def pairs(bucket: pd.DataFrame) -> pd.DataFrame:
        ids, component = bucket["node"].to_numpy(), bucket["component"].to_numpy()
        links = link_components([np.asarray(h, dtype=np.int64) for h in bucket["hashes"]], component, percent) if bucket["component"].nunique() > 1 else []
        out = pd.DataFrame({"u": ids[[a for a, _ in links]], "v": ids[[b for _, b in links]]}, dtype="int64")
        if len(bucket) > LARGE:
            del bucket
            release_memory()
        return out

    return members.groupBy("key", "i", "j").applyInPandas(pairs, "u long, v long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are alike enough."""
    of_member = pairs.join(sets.select(F.col("node").alias("member"), F.col("hashes").alias("x")), "member")
    both = of_member.join(sets.select(F.col("node").alias("hub"), F.col("hashes").alias("y")), "hub")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("hub", "member", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select(F.col("hub").alias("u"), F.col("member").alias("v"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, workspace: Workspace | None = None, block: int = BLOCK, block_hashes: int = BLOCK_HASHES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, group) of each row.

    Linked are texts with 100 * intersection >= percent * union. text_key is xxhash64(text), group the component as a
    number that rows with a null doc_id have too (null for a text without words).
    """
    workspace = workspace or Workspace(docs.sparkSession, "minhash")
    threshold = percent / 100
    low = threshold - SIGMAS * (threshold * (1 - threshold) / BYTES) ** 0.5
    cover = threshold - 2 * (threshold * (1 - threshold) / BYTES) ** 0.5
    table = workspace.save("sketches", sketches(docs, width, threshold))
    nodes = table.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    nodes = workspace.save("nodes", nodes.withColumn("node", F.monotonically_increasing_id()))  # as written, a number for each set

    n_nodes = nodes.count()
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("first"), F.max("node").alias("last")).where("n > 1")
    buckets = workspace.save("buckets", buckets.groupBy("n", "x", "first", "last").agg(F.min("key").alias("key")).select("key", "n", F.col("n").alias("rows")))
    members = workspace.save("members", join_split(keyed, buckets, ["key"], "rows", BANDS * n_nodes, hot_rows=hot_rows).select("key", "n", "node"))

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", F.col("least_id").alias("doc_id"))
    ids = wanted.where("doc_id IS NOT NULL").select("doc_id").distinct()
    of_id = docs.join(ids, "doc_id", "left_semi").select("text").union(docs.where("doc_id IS NULL").select("text"))
    sets = full_sets(of_id, width).join(wanted.select("node", "digest"), "digest").select("node", "hashes").dropDuplicates(["node"])
    sets = workspace.save("sets", sets, compression="lz4")

    pairs = workspace.save("pairs", _covering_pairs(members, nodes, low, cover, workspace, block))
    links = workspace.save("links", _confirmed(pairs, sets, percent))
    placed = members.select("key", "node").join(components(links, workspace, "components-cover"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = workspace.save("placed", placed.join(nodes.select("node", "size"), "node").select("key", "node", "component", "size"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("rows")).where("a <> b").select("key", "rows")
    mixed = workspace.save("mixed", join_split(placed, workspace.save("mixed-keys", mixed), ["key"], "rows", BANDS * n_nodes, hot_rows=hot_rows))
    more = workspace.save("links-rest", _rest(_meetings(mixed, percent, block, block_hashes).join(sets, "node"), percent))
    of_node = workspace.save("components", components(links.union(more), workspace, "components-all"))
    workspace.drop("sets", "members", "placed", "mixed")

    named = nodes.select("node", "digest", "least_id", "copies").join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = workspace.save("named", named)
    least = workspace.save("least", named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")))
    groups = join_split(named, least, ["component"], "n", n_nodes, hot_rows=hot_rows).select("digest", "copies", F.col("component_id").alias("group_id"), F.col("component").alias("group"))
    groups = workspace.save("groups", groups)
    joined = join_split(table.select("doc_id", "n_shingles", "digest", "text_key"), groups, ["digest"], "copies", table.count(), how="left", hot_rows=hot_rows)
    joined = joined.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("group_id")))
    return joined.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "group")


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80, workspace: Workspace | None = None) -> DataFrame:
    """`docs` with one row of each group, that of the least (doc_id, text_key), and all texts without words.

    Rows that are equal in doc_id and text are one document.
    """
    groups = near_duplicates(docs, width, percent, workspace)
    row = F.struct("doc_id", "text_key")
    first = groups.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(row).alias("row")).select("row.*")
    first = first.union(groups.where(F.col("group").isNull()).select("doc_id", "text_key").distinct())
    i, k, mine = unused(docs.columns, "id", "text_key", "text_hash")
    first = first.select(F.col("doc_id").alias(i), F.col("text_key").alias(k))
    keyed = docs.withColumn(mine, F.xxhash64("text"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(mine) == F.col(k)), "left_semi")
    return kept.dropDuplicates(["doc_id", mine]).select(*docs.columns)
