"""A prefix trie over rebuilt conversations, merged family first.

1. Conversations are cogrouped by their base id (a family is a base and the ids after it): one task rebuilds a family's
   conversations, names each prefix by a chained digest of its turns and merges equal prefixes. What leaves the family is
   one row per combined node, with the ids that end there; no text is shuffled again.
2. Nodes of all families are merged by digest, in counts and a least id.
3. The nodes whose smallest member is one conversation lie on its path from some depth down to its end, so the trie is a
   set of paths, and each path but the root's hangs on a node of another one. Sums over subtrees are sums over these
   paths: totals climb from path to path by pointer doubling (the logarithm of the nesting many joins), and running sums along
   a path give its nodes' values. A chain of any length is never walked node by node, and siblings are only ever counted.

Bounds: a family above ``ROWS`` turns or ``BYTES`` isn't held by a task. Its turns are sorted and numbered by Spark, digests
are made in blocks of ``BLOCK`` turns, and only the digests of blocks are chained along a conversation. Ids that end at a
node are joined in ranges of ``IDS`` ids, which one pass hashes in order without holding them.

Defined results: turns are ordered by turn (null first), then role, then text; null role and text are empty; rows without a
conversation's id belong to none and make no node; repeated rows are turns like any other; columns of other names don't
matter; an empty table gives no nodes, any other a root. Digests are SHA-256 of the turns' lengths and bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialised, ship_package

FAMILY = 5
HEADS = 9
#: Turns and bytes of a family that one task holds at most.
ROWS = 20_000
BYTES = 64_000_000
#: Turns whose digests are chained one by one; blocks of them are chained by their own digests.
BLOCK = 16_384
#: Ids, in a row, whose text is one value.
IDS = 1_000
ROOT = bytes(32)
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "digest binary, depth long, parent binary, bytes long, conv long, n long, ends array<long>"


def _sha(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def element(role: str, text: str) -> tuple[bytes, int]:
    """The digest of a turn, and the bytes of its text."""
    raw, said = role.encode(), text.encode()
    return _sha(f"{len(raw)}:".encode(), raw, said), len(said)


class Chain:
    """Digests of growing prefixes: the last of a block is that of the block before and the block's own."""

    def __init__(self, start: bytes = ROOT, block: int = BLOCK) -> None:
        self.at = self.before = start
        self.size, self.n, self.held = block, 0, hashlib.sha256()

    def step(self, turn: bytes) -> bytes:
        self.n += 1
        self.held.update(turn)
        if self.n % self.size:
            self.at = _sha(self.at, turn)
        else:
            self.at = self.before = _sha(self.before, self.held.digest())
            self.held = hashlib.sha256()
        return self.at


def _family(block: int, heads: int):
    def run(bases: pa.Table, others: pa.Table) -> pa.Table:
        turns: dict[int, list] = {}
        for rows in (bases, others):
            for row in rows.to_pylist():
                turns.setdefault(row["conv"], []).append(((row["turn"] is not None, row["turn"]) if row["turn"] is not None else (False, 0), row["role"], row["text"]))
                base = row["base"]
        for own in turns.values():
            own.sort()
        first = turns.get(base, [])
        nodes: dict[bytes, list] = {}
        for conv in sorted(turns):
            h = zlib.crc32(str(conv).encode()) % heads
            chain, digest, parent, size = Chain(block=block), ROOT, None, 0
            rebuilt = first[:h] + turns[conv][h:]
            for depth in range(len(rebuilt) + 1):
                if depth:
                    turn, size = element(*rebuilt[depth - 1][1:])
                    parent, digest = digest, chain.step(turn)
                node = nodes.setdefault(digest, [depth, parent, size, conv, 0, []])
                node[4] += 1
            node[5].append(conv)
        columns = [list(nodes), *map(list, zip(*nodes.values()))]
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "depth", "parent", "bytes", "conv", "n", "ends"])

    return run


def _block_digest(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at")
    whole = hashlib.sha256()
    for turn in rows.column("turn_digest").to_pylist():
        whole.update(turn)
    return pa.table([rows.column("conv")[:1], rows.column("block")[:1], pa.array([whole.digest()])], ["conv", "block", "own"])


def _carries(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("block")
    out, at = [], ROOT
    for own in rows.column("own").to_pylist():
        out.append(at)
        at = _sha(at, own)
    return pa.table([rows.column("conv"), rows.column("block"), pa.array(out, pa.binary())], ["conv", "block", "carry"])


def _block_nodes(block: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        digest = rows.column("carry")[0].as_py()
        chain, digests, parents = Chain(digest, block), [], []
        for turn in rows.column("turn_digest").to_pylist():
            parents.append(digest)
            digest = chain.step(turn)
            digests.append(digest)
        conv, at, last = rows.column("conv").to_pylist(), rows.column("at").to_pylist(), rows.column("length")[0].as_py() - 1
        return pa.table(
            [
                pa.array(digests, pa.binary()), pa.array([k + 1 for k in at], pa.int64()), pa.array(parents, pa.binary()), rows.column("bytes"),
                pa.array(conv, pa.int64()), pa.array([1] * len(at), pa.int64()), pa.array([[c] if k == last else [] for c, k in zip(conv, at, strict=True)], pa.list_(pa.int64())),
            ],
            ["digest", "depth", "parent", "bytes", "conv", "n", "ends"],
        )

    return run


def _head(conv: str, heads: int):
    return F.crc32(F.col(conv).cast("string")) % heads


def long_nodes(rows: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """Nodes of families of any size, a row for each conversation's; no task holds more than a block of turns."""
    turn = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ordered = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first()).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    ordered = materialised(
        ordered.select("conv", "base", turn.alias("turn_digest"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
        .withColumn("part", F.shiftright("row", 33)),
        "turns",
    )
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = ordered.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count("*").alias("k"))
    runs = runs.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    placed = ordered.join(runs, ["conv", "part"]).withColumn("at", F.col("row") - F.col("first") + F.col("before")).drop("row", "part", "first", "before", "k")
    sizes = ordered.groupBy("conv", "base").agg(F.count("*").alias("k"))
    bases = sizes.where("conv = base").select("base", F.col("k").alias("base_k"))
    h = _head("conv", heads)
    lead = F.least(h, F.coalesce("base_k", F.lit(0)))
    convs = materialised(
        sizes.join(bases, "base", "left").select("conv", "base", h.alias("h"), lead.alias("lead"), (lead + F.greatest(F.col("k") - h, F.lit(0))).alias("length")), "long-conversations"
    )
    columns = ["conv", "at", "turn_digest", "bytes", "length"]
    own = placed.drop("base").join(convs, "conv").where("at >= h").withColumn("at", F.col("at") - F.col("h") + F.col("lead")).select(*columns)
    led = placed.where(f"conv = base and at < {heads}").drop("conv").join(convs, "base").where("at < h").select(*columns)
    rebuilt = materialised(own.unionByName(led).withColumn("block", F.floor(F.col("at") / block)), "rebuilt")
    digests = rebuilt.select("conv", "block", "at", "turn_digest").groupBy("conv", "block").applyInArrow(_block_digest, "conv long, block long, own binary")
    carries = digests.groupBy("conv").applyInArrow(_carries, "conv long, block long, carry binary")
    nodes = rebuilt.join(carries, ["conv", "block"]).groupBy("conv", "block").applyInArrow(_block_nodes(block), NODE)
    roots = convs.select(
        F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), "conv", F.lit(1).cast("long").alias("n"),
        F.when(F.col("length") == 0, F.array("conv")).otherwise(F.array().cast("array<long>")).alias("ends"),
    )
    return nodes.unionByName(roots)


def family_nodes(turns: DataFrame, rows: int = ROWS, size: int = BYTES, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """The combined nodes of each family (conv, base, turn, role, text; no nulls but in turn)."""
    large = turns.groupBy("base").agg(F.count("*").alias("k"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("b")).where((F.col("k") > rows) | (F.col("b") > size)).select("base")
    large = materialised(large, "long-families")
    some = not large.isEmpty()
    small = turns.join(large, "base", "left_anti") if some else turns
    bases, others = small.where("conv = base"), small.where("conv <> base").toDF(*small.columns)  # two frames of their own
    nodes = bases.groupBy("base").cogroup(others.groupBy("base")).applyInArrow(_family(block, heads), NODE)
    if some:
        nodes = nodes.unionByName(long_nodes(turns.join(large, "base", "left_semi").select("conv", "base", "turn", "role", "text"), block, heads))
    return materialised(nodes, "family-nodes")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and the hash of its ids, over rows in order of digest and range."""
    now, sha = None, hashlib.sha256()
    for batch in batches:
        found = []
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if digest != now:
                if now is not None:
                    found.append((now, sha.hexdigest()))
                now, sha = digest, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([s for _, s in found], pa.string())], ["digest", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["digest", "ends_sha256"])


def ends(nodes: DataFrame) -> DataFrame:
    """digest, ends_sha256 of the ids that end at a node, where there are any."""
    each = nodes.where(F.size("ends") > 0).select("digest", F.explode("ends").alias("id"))
    ranges = each.groupBy("digest", F.floor(F.col("id") / IDS).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return ranges.repartition("digest").sortWithinPartitions("digest", "range").mapInArrow(_ends, "digest binary, ends_sha256 string")


def climbed(paths: DataFrame) -> DataFrame:
    """conv, up, saved, leaves with the values of a path put onto all that it hangs on, by pointer doubling."""
    paths = materialised(paths, "totals")
    while not paths.where("up is not null").isEmpty():
        live, done = paths.where("up is not null"), paths.where("up is null")
        further = live.join(paths.select(F.col("conv").alias("up"), F.col("up").alias("next")), "up").select("conv", F.col("next").alias("up"), "saved", "leaves")
        gained = live.groupBy(F.col("up").alias("conv")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        paths = materialised(
            further.unionByName(done).join(gained, "conv", "left").select(
                "conv", "up", (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")
            ),
            "totals",
        )
    return paths


def build(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    family: int = FAMILY, heads: int = HEADS, rows: int = ROWS, size: int = BYTES, block: int = BLOCK,
) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship_package(df.sparkSession)
    conv = F.col(f"`{conv_col}`").cast("long")
    text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    turns = df.where(conv.isNotNull()).select(
        conv.alias("conv"), (conv - conv % family).alias("base"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")
    )
    parts = family_nodes(turns, rows, size, block, heads)
    nodes = materialised(parts.groupBy("digest", "depth", "parent", "bytes").agg(F.min("conv").alias("conv"), F.sum("n").alias("n")), "nodes")

    paths = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("end"))
    on_path = nodes.join(paths, "conv")
    hung = on_path.where("depth = top and depth > 0").select("conv", "parent").join(
        nodes.select(F.col("digest").alias("parent"), F.col("conv").alias("up"), F.col("depth").alias("hangs_at")), "parent"
    ).drop("parent")
    tree = materialised(hung, "paths")
    forks = tree.groupBy(F.col("up").alias("conv"), F.col("hangs_at").alias("depth")).agg(F.count("*").alias("forks"))
    children = F.coalesce("forks", F.lit(0)) + (F.col("depth") < F.col("end")).cast("long")
    values = materialised(
        on_path.join(forks, ["conv", "depth"], "left").select(
            "conv", "depth", "digest", "n", "top", children.alias("n_children"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"), (children == 0).cast("long").alias("leaf")
        ),
        "values",
    )
    own = values.groupBy("conv").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    totals = climbed(own.join(tree.select("conv", "up"), "conv", "left").select("conv", "up", "saved", "leaves"))

    below = totals.drop("up").join(tree, "conv").groupBy(F.col("up").alias("conv"), F.col("hangs_at").alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))
    added = values.join(below, ["conv", "depth"], "left").join(tree.drop("hangs_at"), "conv", "left").select(
        "conv", "depth", F.floor(F.col("depth") / block).alias("part"), "digest", "n", "n_children",
        F.when(F.col("depth") > F.col("top"), F.col("conv")).when(F.col("depth") > 0, F.col("up")).alias("parent_conv_id"),
        (F.col("saved") + F.coalesce("hung_saved", F.lit(0))).alias("saved"), (F.col("leaf") + F.coalesce("hung_leaves", F.lit(0))).alias("leaves"),
    )
    added = materialised(added, "added")
    later = Window.partitionBy("conv").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    from_later = added.groupBy("conv", "part").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).select(
        "conv", "part", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("later_saved"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("later_leaves")
    )
    down = Window.partitionBy("conv", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = added.withColumn("saved", F.sum("saved").over(down)).withColumn("leaves", F.sum("leaves").over(down)).join(from_later, ["conv", "part"])
    return summed.join(ends(parts), "digest", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        (F.col("leaves") + F.col("later_leaves")).alias("n_leaves"), (F.col("saved") + F.col("later_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
