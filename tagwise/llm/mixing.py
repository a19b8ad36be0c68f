"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; each of its documents is wanted
``target / source size`` times, which is rarely a whole number. The whole part is taken as
it is. The fractional parts are rounded by the pivotal method: two documents meet, one
passes as much of its fraction to the other as makes one of them 0 or 1, who gives being
drawn so that each document's expected number of copies stays as wanted. All but one
fraction of a block of documents becomes whole this way; the block's remaining fraction
meets those of other blocks one level up, and so on: a reduction tree of fan-in
:data:`FAN_IN` that leaves one fraction a source, drawn at the end. Documents meet others of
about their own size first, so a source's words come near its target, not only its count.

Draws are hashes of the seed, the level and the place, so reruns agree. Built from
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwise.llm.common import word_count, written
from tagwise.operators.ordered import rank_in_key

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
FAN_IN = 32
SEED = 42


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0,
                   most: int = MOST_COPIES) -> DataFrame:
    """``rank, source, source_size, n, target`` of each source of ``sized(source, size, ...)``.

    Sources in code point order, null last, take the weights in turn and divide ``share`` of
    all sizes by them. A target stops at ``most`` times its source's size; what is over goes
    to the other sources by weight, until none is above. One small row a source; each round
    of the division collects two numbers."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")) \
        .withColumn("_one", F.lit(0)).withColumn("_null", F.col("source").isNull()) \
        .withColumn("_name", F.coalesce("source", F.lit("")))
    ranked = rank_in_key(totals, "_one", ["_null", "_name"], "rank").drop("_one", "_null", "_name")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", turn).withColumn("most", (F.col("source_size") * most).cast("double")), "sources")
    wanted = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) > F.col("most") if full >= 0 else F.lit(False)
        used, free, count = ranked.agg(
            F.sum(F.when(capped, F.col("most")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
            F.sum(capped.cast("long"))).first()
        if not free or count == full:
            break
        level, full = (wanted - used) / free, count
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most"))) \
        .select("rank", "source", "source_size", "n", "target")


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _rounded(units: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree. ``units(node, parent, p, size)`` with 0 <= p < 1 are dealt to
    their parents; each parent's units meet in order of size. Returns ``parent, members``
    (in that order), ``won`` (indices that became 1), ``rest`` and ``p`` (index and fraction
    of the remaining one), ``size`` (the remaining unit's)."""
    members = F.array_sort(F.collect_list(F.struct("size", "node", "p")))
    start = F.struct(F.lit(0).alias("rest"), F.element_at("members", 1)["p"].alias("p"),
                     F.array().cast("array<int>").alias("won"))

    def meet(a: Column, i: Column) -> Column:
        p, q = a["p"], F.get("members", i)["p"]
        u = _draw(F.lit(seed), F.lit(level), F.col("parent"), i)
        first = F.when(p + q < 1, u * (p + q) < p).otherwise(u * (2 - p - q) < 1 - q)
        whole = p + q >= 1
        keeps = first != whole          # with a whole one, the winner leaves and the other goes on
        return F.struct(F.when(keeps, a["rest"]).otherwise(i).alias("rest"),
                        F.when(whole, p + q - 1).otherwise(p + q).alias("p"),
                        F.when(whole, F.concat(a["won"], F.array(F.when(first, a["rest"]).otherwise(i))))
                        .otherwise(a["won"]).alias("won"))

    folded = F.aggregate(F.when(F.size("members") > 1, F.sequence(F.lit(1), F.size("members") - 1))
                         .otherwise(F.array().cast("array<int>")), start, meet)
    return units.groupBy("parent").agg(members.alias("members")).withColumn("end", folded) \
        .select("parent", "members", "end.won", "end.rest", "end.p", F.get("members", F.col("end.rest"))["size"].alias("size"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES,
           seed: int = SEED, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every row of ``docs``.

    A null text has size 0 (as an empty one); a null source or key is a value like any other.
    Rows with equal source and key share one decision; the sum of their sizes is what is
    rounded. A source without words has target 0 and no copies; so does every source of an
    empty or wordless table. Extra columns are ignored."""
    sized = written(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                                word_count(F.col(text)).alias("size")), "sizes")
    targets = source_targets(sized, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(float(most)))).otherwise(0.0)
    targets = written(targets.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio)), "targets")

    kind = F.floor(F.log2(F.col("size") + 1) * 2)
    units = sized.groupBy("source", "doc_id").agg(F.sum("size").alias("size")).withColumn("kind", kind)
    fractional = targets.where("part > 0").select("rank", F.col("source").alias("_source"), "part")
    units = units.join(fractional, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    blocks = units.groupBy("rank", "kind").agg(F.ceil(F.count(F.lit(1)) / FAN_IN).alias("blocks"))
    units = written(units.join(blocks, ["rank", "kind"]), "units")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("blocks"))
    units = units.select(F.struct("rank", F.lit(0).cast("long").alias("kind"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name")).alias("node"),
                         F.struct("rank", "kind", block.cast("string").alias("name")).alias("parent"),
                         F.col("part").alias("p"), "size")

    levels = []
    while True:
        nodes = written(_rounded(units, len(levels), seed), f"rounding-{len(levels)}")
        levels.append(nodes)
        per = nodes.groupBy("parent.rank").agg(F.count(F.lit(1)).alias("n"))
        if (per.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        above = F.ceil(F.col("n") / FAN_IN)
        units = nodes.join(per, nodes["parent.rank"] == per["rank"]).select(
            F.col("parent").alias("node"),
            F.struct(F.col("rank"), F.lit(-1 - len(levels)).cast("long").alias("kind"),
                     F.pmod(F.xxhash64(F.lit(seed + len(levels)), F.col("parent")), above).cast("string").alias("name")).alias("parent"),
            "p", "size")
    taken = levels[-1].select(F.col("parent").alias("_node"),
                              (_draw(F.lit(seed), F.lit(-1), F.col("parent")) < F.col("p")).alias("_up"))
    for nodes in reversed(levels):                 # what a node's remaining fraction became goes down
        one = nodes.join(taken, nodes["parent"] == taken["_node"]) \
            .select("won", "rest", "_up", F.posexplode("members").alias("i", "unit"))
        taken = one.select(F.col("unit.node").alias("_node"),
                           F.when(F.col("i") == F.col("rest"), F.col("_up"))
                           .otherwise(F.array_contains("won", F.col("i"))).alias("_up"))
    extra = taken.where("_up").select(F.col("_node.rank").alias("_rank"), F.col("_node.name").alias("_name"), F.lit(1).alias("_extra"))
    rows = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return rows.join(extra, (F.col("rank") == F.col("_rank")) & (F.coalesce(F.col("doc_id").cast("string"), F.lit("null")) == F.col("_name")), "left") \
        .select("doc_id", "source", "size", "source_size", "target",
                (F.col("whole") + F.coalesce("_extra", F.lit(0))).cast("int").alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (not at all for 0), all
    columns kept. The decisions meet the rows by key and source."""
    made = copies(docs, text=text, key=key, source=source, **options) \
        .groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).where("copies > 0") \
        .select(F.col("doc_id").alias("_mix_key"), F.col("source").alias("_mix_source"), F.col("copies").alias("_mix_copies"))
    names = docs.columns
    joined = docs.join(made, F.col(key).eqNullSafe(F.col("_mix_key")) & F.col(source).eqNullSafe(F.col("_mix_source")))
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*names)
