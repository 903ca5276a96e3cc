"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

DataFrame operations only. Documents with equal texts are linked. Start: a pseudo-random deal into shards whose counts
differ by one at most. Each round, every linked document asks for the shard where most of its group is; a quota for
each pair of shards, found from the counts of askers (shards x shards numbers, whatever the input), lets as many
move as can be made up for by movers the other way and by documents without links, which leave in exchange. So every
round keeps the counts, and groups larger than a shard fill one shard after another.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cascadia.functions.prefix import prefix
from cascadia.llm.store import table

ROUNDS = 6
#: Stretches into which running numbers are cut, and rows of a group of copies that go to one task in a join.
BUCKETS, SALTED = 1 << 14, 2048
#: Groups with more than one row in so many are joined by broadcast at first: there are fewer of them than that.
HOT = 1000


def quotas(asked: list[list[int]], free: list[int]) -> list[list[int]]:
    """The most movers from a to b, at most asked[a][b], so that no shard gains more movers than it loses by more
    than its free documents."""
    n = len(free)
    moves = [row[:] for row in asked]
    while True:
        changed = False
        for b in range(n):
            into = sum(moves[a][b] for a in range(n))
            over = into - sum(moves[b]) - free[b]
            for a in sorted(range(n), key=lambda a: -moves[a][b]):
                if over <= 0:
                    break
                less = min(moves[a][b], -(-over * moves[a][b] // max(into, 1)), over)
                less = max(less, 1) if moves[a][b] else 0
                moves[a][b] -= less
                over -= less
                changed |= less > 0
        if not changed:
            return moves


def places(sizes: dict[int, int], room: list[int]) -> tuple[list[tuple[int, int, int, int, int, int]], list[int], int]:
    """Shards for groups, of which there are sizes[c] of size c, the largest first: (c, groups from, to, rows from, to,
    shard), the room left, and how many groups are split that the largest room could have held."""
    room, most, found, late = room[:], max(room), [], []

    def pour(c: int, g: int, at: int = 0) -> None:
        while at < c:
            fits = [b for b in range(len(room)) if room[b] >= c - at]
            b = min(fits, key=lambda b: room[b]) if fits else max(range(len(room)), key=lambda b: room[b])
            rows = min(room[b], c - at)
            found.append((c, g, g + 1, at, at + rows, b))
            room[b] -= rows
            at += rows

    for c in sorted(sizes, reverse=True):
        if c > most:
            for g in range(sizes[c]):
                pour(c, g)
            continue
        fits = [r // c for r in room]
        many = min(sizes[c], sum(fits))
        take = [f * many // max(sum(fits), 1) for f in fits]
        for _ in range(many - sum(take)):
            take[max((b for b in range(len(room)) if take[b] < fits[b]), key=lambda b: room[b] - c * take[b])] += 1
        g = 0
        for b, t in enumerate(take):
            if t:
                found.append((c, g, g + t, 0, c, b))
                room[b] -= c * t
                g += t
        late += [(c, x) for x in range(g, sizes[c])]
    for c, g in late:
        pour(c, g)
    return found, room, len(late)


def _at(xs: list[int]):
    """Of xs the number of a row's shard."""
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("shard") + 1).cast("int"))


def _salts(copies):
    """Into how many parts a group's rows are dealt, so that a hot one does not meet its target in one task."""
    return F.ceil(F.coalesce(copies, F.lit(1)) / SALTED).cast("int")


def _each_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _fillers(state: DataFrame, leave: list[int], lack: list[int]) -> DataFrame:
    """rid, target: so many documents without links of each shard, for the shards that lack some."""
    n = len(leave)
    singles = prefix(state.where("not linked").select("rid", "shard"), ["shard"], F.pmod(F.xxhash64("rid"), F.lit(BUCKETS)), ["rid"], "place")
    turn = _at([sum(leave[:b]) for b in range(n)]) + F.col("place")
    to = F.lit(n - 1)
    for b in reversed(range(n)):
        to = F.when(turn < sum(lack[: b + 1]), b).otherwise(to)
    return singles.where(F.col("place") < _at(leave)).select("rid", to.cast("int").alias("target"))


def _moved(state: DataFrame, targets: DataFrame) -> DataFrame:
    return table(state.join(targets, "rid", "left").withColumn("shard", F.coalesce("target", "shard")).drop("target"), "shard-state")


def _whole(state: DataFrame, n: int) -> DataFrame:
    """The state with split groups that a shard could hold placed whole, as far as room allows; counts stay. What
    comes to the driver are numbers of groups by size and shard."""
    groups = table(state.where("linked").groupBy("key").agg(F.count("*").alias("c"), F.min("shard").alias("shard"), F.max("shard").alias("last")), "shard-groups")
    split = F.col("shard") != F.col("last")
    hist = groups.groupBy("c", F.when(split, -1).otherwise(F.col("shard")).alias("b")).count().collect()
    rows, free = [0] * n, [0] * n
    for r in state.groupBy("shard", "linked").count().collect():
        rows[r["shard"]] += r["count"]
        free[r["shard"]] += 0 if r["linked"] else r["count"]
    if not any(r["b"] < 0 and r["c"] <= max(rows) for r in hist):
        return state
    room, torn, every = rows[:], Counter(), Counter()
    for r in hist:
        every[r["c"]] += r["count"]
        if r["b"] < 0:
            torn[r["c"]] += r["count"]
        else:
            room[r["b"]] -= r["c"] * r["count"]
    found, left, late = places(torn, room)
    late += sum(m for c, m in torn.items() if max(room) < c <= max(rows))
    if late:  # whole groups stand in the way: all are placed anew if that leaves fewer split
        anew = places(every, rows)
        if anew[2] < late:
            (found, left, _), split = anew, F.lit(True)
    plan = state.sparkSession.createDataFrame(found, "c long, g0 long, g1 long, r0 long, r1 long, target int")
    ranked = prefix(groups.where(split).select("key", "c"), ["c"], F.pmod(F.xxhash64("key"), F.lit(BUCKETS)), ["key"], "g")
    ranked = table(ranked.join(F.broadcast(plan.withColumnRenamed("c", "of")), (F.col("c") == F.col("of")) & (F.col("g") >= F.col("g0")) & (F.col("g") < F.col("g1"))).select("key", "c", "r0", "r1", "target"), "shard-places")
    whole = (F.col("r0") == 0) & (F.col("r1") == F.col("c"))
    movers = state.join(_each_salt(ranked.where(whole).select("key", "target", _salts(F.col("c")).alias("salts"))), ["key", "salt"]).select("rid", "target")
    pieces = F.broadcast(ranked.where(~whole).select(F.col("key").alias("of"), "r0", "r1", "target"))
    turns = prefix(state.join(F.broadcast(ranked.where(~whole).select("key").distinct()), "key").select("rid", "key"), ["key"], F.pmod(F.xxhash64("rid"), F.lit(BUCKETS)), ["rid"], "turn")
    turns = turns.join(pieces, (F.col("key") == F.col("of")) & (F.col("turn") >= F.col("r0")) & (F.col("turn") < F.col("r1"))).select("rid", "target")
    leave, lack = ([max(0, s * (f - x)) for f, x in zip(free, left, strict=True)] for s in (1, -1))
    return _moved(state, movers.unionByName(turns).unionByName(_fillers(state, leave, lack)))


def shard(docs: DataFrame, n: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """Adds to docs' doc_id: size (UTF-8 bytes of the text plus 1), text_crc32, shard (0 to n - 1) and slot (gapless
    in the shard); counts of the shards differ by one at most.

    A null text counts as an empty one, and empty texts are equal texts. Repeated doc_ids and whole repeated rows are
    documents of their own; a null doc_id is kept. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")).withColumn("mixed", F.xxhash64("doc_id", "key")),
        "shard-rows",
    )
    rows = prefix(rows, [], F.pmod("mixed", F.lit(BUCKETS)), ["mixed", "doc_id"], "rid")
    rows = table(rows, "shard-numbered")
    groups = table(rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "shard-copies")
    hot = F.col("copies") * HOT > rows.count()
    large = groups.where(hot)  # fewer than HOT rows
    marked = rows.join(F.broadcast(large), "key").unionByName(rows.join(F.broadcast(large.select("key")), "key", "left_anti").join(groups.where(~hot), "key", "left"), allowMissingColumns=True)
    salts = _salts(F.col("copies"))
    state = table(marked.withColumn("linked", F.col("copies").isNotNull()).withColumn("salts", salts).withColumn("salt", F.pmod("rid", salts).cast("int")).withColumn("shard", F.pmod("rid", F.lit(n)).cast("int")).drop("copies"), "shard-state")
    full: list[int] = []
    for _ in range(rounds):
        free = [0] * n
        for r in state.where("not linked").groupBy("shard").count().collect():
            free[r["shard"]] = r["count"]
        counts = state.where("linked").groupBy("key", "shard").agg(F.count("*").alias("c"), F.max("salts").alias("salts"))
        held = F.array(*[F.lit(x) for x in full]).cast("array<int>")
        best = F.expr("max_by(shard, struct(c, xxhash64(key, shard)))")  # ties spread over the shards
        by_key = counts.where(~F.array_contains(held, F.col("shard"))).groupBy("key").agg(best.alias("target"), F.max("c").alias("there"))
        wish = counts.join(by_key, "key").where(~F.array_contains(held, F.col("shard")) & (F.col("target") != F.col("shard"))).select("key", "shard", "target", (F.col("there") - F.col("c") + 1).alias("gain"), "salts")
        asking = table(state.where("linked").select("rid", "key", "shard", "salt").join(_each_salt(wish), ["key", "shard", "salt"]).select("rid", "shard", "target", "gain"), "shard-asking")
        asked = [[0] * n for _ in range(n)]
        for r in asking.groupBy("shard", "target").count().collect():
            asked[r["shard"]][r["target"]] = r["count"]
        moves = quotas(asked, free)
        if not sum(map(sum, moves)):
            break
        band = (F.lit(63) - F.floor(F.log2(F.col("gain")))) * 256 + F.pmod(F.xxhash64("rid"), F.lit(256))
        ranked = prefix(asking, ["shard", "target"], band, ["rid"], "place")
        limit = F.element_at(F.array(*[F.lit(x) for row in moves for x in row]), (F.col("shard") * n + F.col("target") + 1).cast("int"))
        movers = ranked.where(F.col("place") < limit).select("rid", "target")
        gain = [sum(moves[a][b] for a in range(n)) - sum(moves[b]) for b in range(n)]
        leave, lack = [max(0, g) for g in gain], [max(0, -g) for g in gain]
        state = _moved(state, movers.unionByName(_fillers(state, leave, lack)))
        # a shard that no free document or asker can leave takes no more
        left = [free[b] - leave[b] for b in range(n)]
        full = [b for b in range(n) if left[b] + lack[b] == 0 and sum(asked[b]) == sum(moves[b])]
    placed = prefix(_whole(state, n), ["shard"], F.pmod("mixed", F.lit(BUCKETS)), ["mixed", "rid"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")




def op4_sharding(spark, sf_dir):
    """All documents in 8 shards whose counts differ by one at most, equal texts together as far as that allows."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
