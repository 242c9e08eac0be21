"""Operator 10: shards by balanced label propagation, in DataFrame operations.

Documents that share a link hub (here: the digest of an equal text) want to be
in one shard.  Labels start by hub: a plan made from the sizes of the hubs and
their counts gives each hub that fits a shard a place as a whole, and hubs
larger than a shard the shards left empty for them and what the others leave.
Then, in each round, a join counts every hub's members by shard, each document
asks for the shard where most of its neighbours are, and movers are accepted up
to what the shard's capacity leaves after its linked documents.  Rounds go on
until none accepts a move or brings more neighbours together.  Documents
without links then fill the shards to their exact capacities.

A hub that fits a shard is cut only if, larger hubs first and each in the
fullest shard that holds it, no shard is left with room for it; these are fewer
than the shards.

Law ``rows``: capacities are row counts that differ by one at most, and both
steps keep to them, so counts are at most one apart.

No group meets in one task: counts combine before the shuffle, joins on a hub
are plain equi-joins that adaptive execution splits, and ranks are taken
within the even partitions of the written table, whose totals are added up.
Tables of a round are removed when its successor is written.  The
driver sees one row per distinct hub size (at most sqrt(2 n) for n rows) and
the hubs that are cut.

Edge cases: a null text has no links and size 1; empty texts equal each other;
null or repeated ids are rows like others; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, id_text, read_table

N_SHARDS = 8
#: monotonically_increasing_id() has the partition above this bit.
_PART_BIT = 33


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    """Adds ``rank``, gapless from 0 within ``by``, in the order of ``node``."""
    part = F.shiftright("node", _PART_BIT).alias("part")
    inside = Window.partitionBy("part", *by).orderBy("node")
    local = rows.select("*", part).withColumn("_local", F.row_number().over(inside) - 1)
    sums = rows.groupBy(part, *by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        local.join(offsets, ["part", *by])
        .withColumn("rank", (F.col("_before") + F.col("_local")).cast("long"))
        .drop("part", "_local", "_before")
    )


def _counts(rows: DataFrame, n_shards: int) -> list[int]:
    """Rows by shard: a list of ``n_shards`` numbers."""
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def _of_shard(values: list[int], column: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (F.col(column) + 1).cast("int"))


def _filled(rank: F.Column, room: list[int]) -> F.Column:
    """The shard that a rank falls into when shards take ``room`` rows each."""
    shard, end = F, 0
    for s, n in enumerate(room):
        end += n
        shard = shard.when(rank < end, s)
    return shard.otherwise(len(room) - 1)


def _packed(classes: list[tuple[int, int]], room: list[int]) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places hubs whole, in the fullest shard that holds them; takes ``room``.

    ``classes``: (size, hubs of that size).  Gives (size, low, high, shard) for
    the hubs ranked from low to below high, and how many hubs are left over.
    """
    spans, left = [], 0
    for size, count in sorted(classes, reverse=True):
        low = 0
        for s in sorted(range(len(room)), key=lambda s: room[s]):
            high = min(count, low + room[s] // size)
            if high > low:
                spans.append((size, low, high, s))
                room[s] -= size * (high - low)
                low = high
        left += count - low
    return spans, left


def plan(classes: list[tuple[int, int]], capacity: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
    """Spans of whole hubs, the room they leave and the shards kept for others.

    Hubs larger than a shard get as many whole shards as leave the fewest other
    hubs cut, so they stay together only where that costs no hub that fits.
    """
    largest = max(capacity)
    fitting = [(n, c) for n, c in classes if n <= largest]
    over = sum(n * c for n, c in classes if n > largest)
    order = sorted(range(len(capacity)), key=lambda s: -capacity[s])
    best = None
    for kept in range(len(order), -1, -1):
        if sum(capacity[s] for s in order[:kept]) > over:
            continue
        room = [0 if s in order[:kept] else c for s, c in enumerate(capacity)]
        spans, left = _packed(fitting, room)
        if best is None or left < best[0]:
            best = left, spans, room, order[:kept]
    _, spans, room, kept = best
    for s in kept:
        room[s] = capacity[s]
    return spans, room, kept


def _dealt(cut: list[tuple], capacity: list[int], room: list[int], kept: list[int]) -> list[tuple]:
    """(hub, low, high, shard) for the members of hubs that no shard holds."""
    spans, room = [], list(room)
    largest = max(capacity)
    for hub, n in sorted(cut, key=lambda r: (r[1] > largest, -r[1], bytes(str(r[0]), "utf-8"))):
        own = kept if n > largest else []
        rest = sorted((s for s in range(len(room)) if s not in kept), key=lambda s: -room[s])
        low = 0
        for s in [*own, *rest, *kept]:
            high = min(n, low + room[s])
            if high > low:
                spans.append((hub, low, high, s))
                room[s] -= high - low
                low = high
    return spans


def _first_labels(links: DataFrame, capacity: list[int], shelf: Shelf) -> DataFrame:
    """node, shard: every hub that the plan has room for lies whole in a shard."""
    spark = links.sparkSession
    homes = shelf.put(links.groupBy("node").agg(F.min("hub").alias("home")), "shard-homes")
    sizes = homes.groupBy("home").agg(F.count(F.lit(1)).alias("n"))
    hubs = shelf.put(sizes.withColumn("node", F.monotonically_increasing_id()), "shard-hubs")
    classes = [(r["n"], r["c"]) for r in hubs.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()]
    spans, room, kept = plan(classes, capacity)
    table = F.broadcast(spark.createDataFrame(spans, "n long, low long, high long, shard int"))
    ranked = _ranked(hubs, "n")
    at = (ranked["n"] == table["n"]) & (ranked["rank"] >= table["low"]) & (ranked["rank"] < table["high"])
    placed = shelf.put(ranked.join(table, at, "left").select("home", ranked["n"], "shard"), "shard-hub-labels")
    shelf.drop(hubs)
    whole = homes.join(placed.where("shard is not null").select("home", "shard"), "home").select("node", "shard")
    cut = [(r["home"], r["n"]) for r in placed.where("shard is null").select("home", "n").collect()]
    if not cut:
        return whole
    home = homes.schema["home"].dataType.simpleString()
    pieces = F.broadcast(spark.createDataFrame(_dealt(cut, capacity, room, kept), f"home {home}, low long, high long, shard int"))
    members = _ranked(homes.join(F.broadcast(pieces.select("home").distinct()), "home"), "home")
    at = (members["home"] == pieces["home"]) & (members["rank"] >= pieces["low"]) & (members["rank"] < pieces["high"])
    return whole.unionByName(members.join(pieces, at).select("node", "shard"))


def _together(state: DataFrame) -> int:
    """Pairs of a hub's members in one shard, both orders and selves counted."""
    tally = state.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("w"))
    return tally.agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0)).alias("pairs")).first()["pairs"]


def propagate(links: DataFrame, capacity: list[int], shelf: Shelf | None = None) -> DataFrame:
    """Labels for ``links(node, hub)``: node and shard, one row per linked node.

    ``capacity``: the most linked nodes of each shard; their sum must cover all.
    ``node`` must come from ``monotonically_increasing_id`` of a written table.
    """
    shelf, own = shelf or Shelf(links.sparkSession), Shelf(links.sparkSession)
    state = shelf.put(links.join(_first_labels(links, capacity, own), "node"), "shard-labels")
    own.clear()
    together = _together(state)
    while True:
        labels = state.dropDuplicates(["node"])
        room = [c - n for c, n in zip(capacity, _counts(labels, len(capacity)))]
        tally = state.groupBy("hub", F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("w"))
        votes = (
            state.join(tally, "hub")
            .where((F.col("to") == F.col("shard")) | (_of_shard(room, "to") > 0))
            .groupBy("node", "shard", "to")
            .agg(F.sum("w").alias("w"), F.min("hub").alias("hub"))
        )
        choice = F.struct("w", F.xxhash64("hub", "to"))
        wishes = votes.groupBy("node", "shard").agg(F.max_by("to", choice).alias("to")).where("to <> shard")
        ranked = _ranked(wishes.select("node", "to"), "to")
        moves = own.put(ranked.where(F.col("rank") < _of_shard(room, "to")).select("node", "to"), "shard-moves")
        if moves.isEmpty():
            break
        moved = shelf.put(
            state.join(moves, "node", "left").select("node", "hub", F.coalesce("to", "shard").alias("shard")),
            "shard-labels",
        )
        own.clear()
        # the count grows with every round that is kept, so rounds end
        now = _together(moved)
        if now <= together:
            shelf.drop(moved)
            break
        shelf.drop(state)
        state, together = moved, now
    own.clear()
    return state.dropDuplicates(["node"]).select("node", "shard")


def cut_links(assigned: DataFrame) -> DataFrame:
    """Of ``assigned(hub, shard)``: links of a hub's members outside its main shard."""
    tally = assigned.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("w"))
    per_hub = tally.groupBy("hub").agg((F.sum("w") - F.max("w")).alias("cut"))
    return per_hub.agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("cut_links"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, hub, shard, slot of every row of ``docs``."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    shelf = Shelf(docs.sparkSession)
    digests = id_text(docs).select(
        "doc_id",
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(raw))).alias("hub"),
    )
    # dealt evenly before they are numbered, as ranks are taken within these partitions
    even = digests.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = shelf.put(even.withColumn("node", F.monotonically_increasing_id()), "shard-nodes")
    shared = base.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = shelf.put(base.join(shared.select("hub"), "hub").select("node", "hub"), "shard-links")
    total = base.count()
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    found = Shelf(docs.sparkSession)
    labels = shelf.put(propagate(links, capacity, found), "shard-linked")
    found.clear()
    shelf.drop(links)
    room = [c - n for c, n in zip(capacity, _counts(labels, n_shards))]
    free = base.join(labels, "node", "left_anti").select("node")
    filled = _ranked(free).select("node", _filled(F.col("rank"), room).cast("int").alias("shard"))
    placed = shelf.put(labels.unionByName(filled), "shard-placed")
    shelf.drop(labels)
    return base.join(_ranked(placed, "shard"), "node").select(
        "doc_id", "size", "text_crc32", "hub", "shard", F.col("rank").alias("slot")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(read_table(spark, sf_dir, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
