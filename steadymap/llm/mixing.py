"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target number of words; each of its documents should be taken target / source size
times, a whole number of copies plus a fraction. Fractions are rounded in pairs: mass moves from one
document to the other, in a random direction whose odds keep both expectations, until one is whole. What a
pair moves is weighted by size, so the words taken from a source stay the same up to one open document.
Documents are folded in groups of about ``fan``; the open document of each group goes to the next level of
a tree of groups, down to one per source. Randomness comes from hashes of ids, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadymap.llm.common import Stage

WORD = r"[^\x20\x09-\x0D]+"
ITEM = "struct<h:bigint, doc_id:bigint, size:bigint, base:bigint, p:double>"
DONE = "array<struct<doc_id:bigint, size:bigint, copies:bigint>>"


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    fan: int = 64
    seed: int = 13


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words; a null text has none."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """source, documents, source_size, target.

    Sources in code point order, null last, weigh ``weights``, repeating. A target above ``most`` times its
    source's size stops there and the excess goes to the others by weight. That ends at one level: taking
    sources by rising limit per weight, the first whose limit the level of the rest does not exceed.
    """
    weight = F.element_at(F.array(*map(F.lit, settings.weights)), (F.pmod(F.col("place") - 1, F.lit(len(settings.weights))) + 1).cast("int"))
    per = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    # windows over one row per source
    placed = per.withColumn("place", F.expr("row_number() over (order by source asc nulls last)")).withColumn("weight", weight)
    placed = placed.withColumn("limit", settings.most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    levels = placed.selectExpr(
        "*", f"{settings.share}D * sum(source_size) over () as whole",
        "coalesce(sum(limit) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0D) as full",
        "sum(weight) over (order by ratio, place rows between current row and unbounded following) as open").withColumn(
        "level", F.expr("(whole - full) / open"))
    return levels.withColumn("level", F.expr("min_by(level, case when level <= ratio then struct(ratio, place) end) over ()")).select(
        "source", "documents", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def _uniform(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / float(1 << 53)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with(item: Column, p: Column) -> Column:
    return F.struct(item["h"].alias("h"), item["doc_id"].alias("doc_id"), item["size"].alias("size"), item["base"].alias("base"), p.alias("p"))


def _closed(item: Column, q: Column) -> Column:
    """The finished document as an array of one, or an empty array while it is open."""
    row = F.struct(item["doc_id"].alias("doc_id"), item["size"].alias("size"), (item["base"] + q.cast("long")).alias("copies"))
    return F.when((q <= 0) | (q >= 1), F.array(row)).otherwise(F.lit(None).cast(DONE))


def _pair(state: Column, b: Column, seed: Column) -> Column:
    """One step of the fold: the open document ``state.held`` meets ``b``."""
    a, done = state["held"], state["done"]
    room_a, room_b = a["size"] * (1 - a["p"]), b["size"] * (1 - b["p"])
    mass_a, mass_b = a["size"] * a["p"], b["size"] * b["p"]
    up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)
    rises = _uniform(a["doc_id"], b["doc_id"], a["h"], seed) * (up + down) < down
    p_a = F.when(rises, F.when(room_a <= mass_b, 1.0).otherwise(a["p"] + up / a["size"])).otherwise(
        F.when(mass_a <= room_b, 0.0).otherwise(a["p"] - down / a["size"]))
    p_b = F.when(rises, F.when(mass_b <= room_a, 0.0).otherwise(b["p"] - up / b["size"])).otherwise(
        F.when(room_b <= mass_a, 1.0).otherwise(b["p"] + down / b["size"]))

    def settle(z: Column) -> Column:
        open_a, open_b = (z["a"] > 0) & (z["a"] < 1), (z["b"] > 0) & (z["b"] < 1)
        held = F.when(open_a, _with(a, z["a"])).when(open_b, _with(b, z["b"]))
        new = F.filter(F.array(_closed(a, z["a"]), _closed(b, z["b"])), lambda x: x.isNotNull())
        return F.struct(held.cast(ITEM).alias("held"), F.concat(done, F.flatten(new)).alias("done"))

    # rounding errors must not leave a fraction that is whole but for the last digits
    whole = lambda p: F.when(p < 1e-12, 0.0).when(p > 1 - 1e-12, 1.0).otherwise(p)
    both = _let(F.struct(whole(p_a).alias("a"), whole(p_b).alias("b")), settle)
    return F.when(a.isNull(), F.struct(b.cast(ITEM).alias("held"), done.alias("done"))).otherwise(both)


def fold(items: DataFrame, level: int, settings: Settings) -> DataFrame:
    """source, place, item -> one row per group: its open document and the finished ones."""
    start = F.struct(F.lit(None).cast(ITEM).alias("held"), F.array().cast(DONE).alias("done"))
    seed = F.lit(settings.seed * 1000 + level)
    return items.groupBy("source", "place").agg(F.sort_array(F.collect_list("item")).alias("items")).select(
        "source", "place", F.aggregate("items", start, lambda s, x: _pair(s, x, seed)).alias("state")).select(
        "source", "place", "state.held", "state.done")


def rounded(placed: DataFrame, stage: Stage, settings: Settings) -> DataFrame:
    """source, doc_id, size, copies. ``placed``: source, documents, doc_id, size, base, p."""
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    whole = placed.where(~open_).select("source", "doc_id", "size", F.col("base").alias("copies"))
    h = F.xxhash64("doc_id", F.lit(settings.seed))
    item = F.struct(h.alias("h"), "doc_id", "size", "base", "p").cast(ITEM)
    groups = F.ceil(F.col("documents") / settings.fan)
    items = placed.where(open_).select("source", F.pmod(h, groups).alias("place"), item.alias("item"))
    most, level, parts = placed.agg(F.max(groups)).first()[0] or 1, 0, [whole]
    while True:
        folded = stage.save(fold(items, level, settings), f"level-{level}")
        parts.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        left = stage.again(f"level-{level}", folded).where("held is not null").select(
            "source", F.floor(F.col("place") / settings.fan).alias("place"), F.col("held").alias("item"))
        if most <= 1:
            break
        most, level, items = -(-most // settings.fan), level + 1, left
    chance = _uniform(F.col("item.doc_id"), F.col("item.h"), F.lit(settings.seed)) < F.col("item.p")
    parts.append(left.select("source", "item.doc_id", "item.size", (F.col("item.base") + chance.cast("long")).alias("copies")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    ``taken`` is ``copies`` times ``size``; copies are target / source size rounded down or up, so at most
    ``most``. Texts without words have size 0 and count as base copies. A null source is a source of its
    own. Repeated rows are rounded one by one. Without any words all targets are 0. An empty table gives
    no rows; further columns are ignored.
    """
    stage = Stage(docs.sparkSession, "mixing")
    sized = stage.save(sizes(docs), "sizes")
    goals = stage.save(targets(sized, settings), "targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(settings.most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    placed = stage.again("sizes", sized).alias("d").join(goals.alias("g"), F.expr("d.source <=> g.source")).select(
        "d.source", "documents", "doc_id", "size", F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("p"))
    done = rounded(placed, stage, settings)
    again = stage.again("targets", goals)
    return done.alias("r").join(again.alias("g"), F.expr("r.source <=> g.source")).select(
        "doc_id", "r.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, 0 to ``most`` times, with all its columns.

    Rows equal in all columns are one row here and taken as often as they are together; rows that differ in any
    column are kept apart. Null texts have size 0, a null source is a source of its own, an empty table stays empty.
    """
    key = F.xxhash64(*docs.columns)
    copies = mix(docs.select(key.alias("doc_id"), "text", "source"), settings).groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("copies"))
    # the row travels as one struct, so no column of it can clash with the keys; two hashes tell rows apart
    once = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.xxhash64(F.lit(settings.seed), *docs.columns).alias("other"))
    taken = once.dropDuplicates(["key", "other"]).join(copies.where("copies > 0"), "key")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
