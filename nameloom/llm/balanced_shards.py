"""Sharding by balanced label propagation; law ``bytes``: shard sizes near equal.

Links.  Equal texts form groups; each group is a hub vertex linked to its documents, so
links are as many as linked documents, never pairs.  A group of more than nine
tenths of a shard gets several hubs (salted by hash), each of which can stay whole.

Propagation.  Linked documents start at a hash-random shard.  In every round hubs
take the shard that holds most of their bytes, then documents propose to move to
their hub's shard; a shard accepts proposals, in hash order and by distributed prefix sums,
while they fit its free capacity (a shard's equal share of all bytes).  A move never breaks
the quota and always removes a cut link.

Filling.  Documents without links have no cut to lose; they level the shards.
The large ones (over 1/``BIG`` of a share, so at most shards * BIG of them) go one by one,
largest first, to the shard with the least; the others fill what is missing
up to a common level, by prefix sums in hash order.  So sizes differ by less than
1/``BIG`` of a share, unless a single document is larger than that.

Slots number each shard's rows from 0 without gaps (prefix sums again).

Cases: null text has 16 bytes and no links; rows with equal or null doc_ids are rows
of their own; fewer rows than shards leave shards empty; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameloom.llm.common import KEY_BITS, bucket_bits, hash_key, materialise, prefix_sums

BIG, OVERHEAD, ROUNDS = 200, 16, 3


def _hashed(df: DataFrame, bits: int) -> DataFrame:
    return df.withColumn("_bucket", F.shiftright("_key", KEY_BITS - bits) if bits else F.lit(0).cast("long"))


def propagate(linked: DataFrame, shards: int, share: float, bits: int, rounds: int = ROUNDS) -> DataFrame:
    """(id, size, hub, _key, shard) of ``linked`` (id, size, hub, _key) after ``rounds`` of moves."""
    start = (F.col("_key") / F.lit(float(1 << KEY_BITS)) * shards).cast("int")
    now = materialise(linked.withColumn("shard", start), "shards-0")
    for turn in range(1, rounds + 1):
        held = now.groupBy("hub", "shard").agg(F.sum("size").alias("bytes"))
        wish = held.groupBy("hub").agg(F.max_by("shard", F.struct("bytes", F.xxhash64("hub", "shard"))).alias("to"))
        load = now.groupBy("shard").agg(F.sum("size").alias("load")).select(F.col("shard").alias("to"), "load")
        moves = now.join(wish, "hub").where("shard <> to").select("id", "size", "_key", "to")
        moves = prefix_sums(_hashed(moves, bits), ["to"], "_bucket", [F.col("_key"), F.col("id")], "size", "_before")
        room = F.lit(share) - F.coalesce(F.col("load"), F.lit(0))
        moves = moves.join(load, "to", "left").where(F.col("_before") + F.col("size") <= room).select("id", "to")
        now = materialise(now.join(moves, "id", "left").select("id", "size", "hub", "_key", F.coalesce("to", "shard").alias("shard")), f"shards-{turn}")
    return now


def _loads(df: DataFrame, shards: int) -> DataFrame:
    """(shard, load) for every shard; ``shards`` rows."""
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(df.groupBy("shard").agg(F.sum("size").alias("load")), "shard", "left").select("shard", F.coalesce("load", F.lit(0)).cast("long").alias("load"))


def deal_big(big: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """(id, shard): largest first, each to the least loaded shard.  ``big`` has at most shards * BIG rows."""
    order = big.agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "_key", "id")))).alias("items"))
    start = loads.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "load"))), lambda s: s["load"]).alias("loads"))
    least = lambda a: F.array_position(a["loads"], F.array_min(a["loads"])).cast("int") - 1

    def give(a, x):
        to = least(a)
        return F.struct(F.transform(a["loads"], lambda v, i: F.when(i == to, v + x["size"]).otherwise(v)).alias("loads"), F.array_append(a["out"], to).alias("out"))

    begin = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("out"))
    dealt = order.join(F.broadcast(start)).select("items", F.aggregate("items", begin, give)["out"].alias("out"))
    return dealt.select(F.explode(F.arrays_zip("items", "out")).alias("z")).select(F.col("z.items.id").alias("id"), F.col("z.out").alias("shard"))


def fill(rest: DataFrame, loads: DataFrame, shards: int, bits: int) -> DataFrame:
    """(id, shard): ``rest`` raises the shards with least to a common level."""
    total = rest.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    table = sorted((r["load"], r["shard"]) for r in loads.collect())  # one row per shard
    level, below = 0.0, 0
    for k in range(1, shards + 1):
        below += table[k - 1][0]
        level = (total["s"] + below) / k
        if k == shards or level <= table[k][0]:
            break
    ends, order, at = [], [], 0.0
    for load, shard in table:
        if load < level or not ends:
            at += max(0.0, level - load)
            ends.append(at)
            order.append(shard)
    summed = prefix_sums(_hashed(rest.withColumn("_all", F.lit(0)), bits), ["_all"], "_bucket", [F.col("_key"), F.col("id")], "size", "_before")
    middle = F.col("_before") + F.col("size") / 2
    place = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= middle)), F.lit(len(ends) - 1))
    return summed.select("id", F.get(F.array(*[F.lit(s) for s in order]), place).alias("shard"))


def shard_rows(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, id of every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5("text").alias("group"))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("_key", hash_key("doc_id", "text_crc32", seed="shard-1")), "shard-rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits, share = bucket_bits(n), total / shards
    groups = rows.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    salt = F.pmod(F.shiftright("_key", 7), F.greatest(F.lit(1), F.ceil(F.col("bytes") / (share * 0.9))).cast("long"))
    linked = rows.join(groups.select("group", "bytes"), "group").select("id", "size", "_key", F.concat_ws("#", "group", salt).alias("hub"))
    placed = propagate(linked, shards, share, bits, rounds).select("id", "size", "shard")

    free = materialise(rows.join(placed.select("id"), "id", "left_anti").select("id", "size", "_key"), "shard-free")
    large = F.col("size") > share / BIG
    big = deal_big(free.where(large), _loads(placed, shards), shards)
    big = materialise(free.join(big, "id").select("id", "size", "shard"), "shard-big")
    loads = materialise(_loads(placed.unionByName(big), shards), "shard-loads")
    small = fill(free.where(~large), loads, shards, bits)
    where = placed.select("id", "shard").unionByName(big.select("id", "shard")).unionByName(small)
    out = materialise(rows.join(where, "id").select("doc_id", "size", "text_crc32", "id", "_key", F.col("shard").cast("int").alias("shard")), "shard-placed")
    out = prefix_sums(_hashed(out.withColumn("_one", F.lit(1).cast("long")), max(0, bits - 5)), ["shard"], "_bucket", [F.col("_key"), F.col("id")], "_one", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "id")
