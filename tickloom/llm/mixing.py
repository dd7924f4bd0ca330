"""Mixing sources to target weights by pivotal dependent rounding (operator 9).

Every document of a source should be taken at the same rate, the source's target over its size. The
whole part of the rate gives sure copies; the rest is a probability of one copy more, the same for
all documents of the source. Rounding each document by itself would miss the target by chance. The
pivotal method rounds them together: of two documents with fractional mass (probability times
words), one randomly gives mass to the other until one of them has none or all; it is decided, the
other goes on. No mass is lost, so only the last document of a source is rounded.

This is done in a tree. Documents of similar size meet in buckets of about ``FAN``, the undecided
ones of the buckets meet again, until each source has one left for each size class, and these meet
last, large ones first, so that what remains is small. The buckets follow from hashes of the rows, so reruns agree.

Only DataFrame functions are used; masses are whole numbers of 2**-20 words, so nothing drifts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import stored, text_key, workspace

#: Documents that meet in one bucket.
FAN = 64
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words to take in all, and from one source at most, in parts of what there is.
SHARE, MOST = 1.5, 2.0

_ONE = 1 << 20
_SEED = 20_011


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source.

    The sources, in the order of their code points with null last, get the weights in turn. A target
    above ``most`` times the size is cut to it, and what is cut goes to the others by weight.
    That ends at one level per unit of weight: sources are cut in the order of capacity over
    weight, until the level the rest would get is below their own.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))
    weighed = totals.withColumn(
        "weight", F.element_at(turn, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("room", F.col("source_size") * F.lit(most) / F.col("weight"))
    everything = Window.partitionBy()
    filled = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = filled.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(share)
        - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most)
    ) / F.sum("weight").over(left)
    levels = weighed.withColumns({"level": level, "turn": F.row_number().over(filled)})
    fits = F.when(F.col("level") <= F.col("room"), F.struct("turn", "level"))
    final = F.min(fits).over(everything)["level"]
    own = F.col("weight") * F.coalesce(final, F.col("room"))
    return levels.withColumn("target", F.least(own, F.col("source_size") * F.lit(most))).select(
        "source", "source_size", "target"
    )


def _chance(*parts: Column) -> Column:
    """A number from 0 to 1 that follows from the parts."""
    return F.pmod(F.xxhash64(*parts, F.lit(_SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _meet(state: Column, other: Column) -> Column:
    """The undecided document meets the next one; one of them is decided."""
    a, b = state["open"], other
    up_a = F.least(a["room"] - a["mass"], b["mass"])  # what a can take from b
    up_b = F.least(b["room"] - b["mass"], a["mass"])
    rise = _chance(a["key"], b["key"], a["mass"], b["mass"]) * (up_a + up_b) < up_b
    moved = F.when(rise, up_a).otherwise(-up_b)
    mass_a, mass_b = a["mass"] + moved, b["mass"] - moved
    first = (mass_a == 0) | (mass_a == a["room"])

    def unit(u: Column, mass: Column) -> Column:
        return F.struct(
            u["order"].alias("order"), u["key"].alias("key"), u["room"].alias("room"), mass.alias("mass"), u["id"].alias("id")
        )

    a, b = unit(a, mass_a), unit(b, mass_b)
    done = F.when(first, a).otherwise(b)
    return F.struct(
        F.when(first, b).otherwise(a).alias("open"), F.concat(state["done"], F.array(done)).alias("done")
    )


def _round(units: DataFrame, *keys: str) -> DataFrame:
    """For each bucket the decided units and the one left open, largest documents first."""
    all_units = F.array_sort(F.collect_list("unit"))
    listed = units.groupBy(*keys).agg(all_units.alias("units"))
    none = F.slice("units", 1, 0)
    start = F.struct(F.element_at("units", 1).alias("open"), none.alias("done"))
    rest = F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0)))
    return listed.select(*keys, F.aggregate(rest, start, _meet).alias("state")).select(*keys, "state.open", "state.done")


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """How often each row of ``docs`` (doc_id, source, text) is taken.

    One row per row of ``docs``: doc_id, high and low (a key of the text), source, size (words),
    source_size, target, copies, taken (size times copies). A null text has no words. Rows without words are
    taken as often as the whole part of their source's rate. Null is a source of its own.
    Repeated rows are drawn one by one. An empty table gives no rows; without any word every target is 0.
    """
    with workspace(docs.sparkSession):
        return stored(_copies(docs, weights, share, most), "copies", keep=True)


def _copies(docs: DataFrame, weights, share: float, most: float) -> DataFrame:
    key = text_key(F.col("text"))
    sized = docs.select(
        F.col("doc_id").cast("bigint"), key.high.alias("high"), key.low.alias("low"), "source", word_count(F.col("text")).alias("size")
    )
    identity = ["doc_id", "high", "low", "source", "size"]
    sized = stored(sized.groupBy(*identity).count(), "sized")
    sources = stored(
        source_targets(sized.select("source", (F.col("size") * F.col("count")).alias("size")), weights, share, most),
        "sources",
    )
    named = sources.withColumnRenamed("source", "name")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized.join(named, F.col("source").eqNullSafe(F.col("name")), "left")
        .withColumn("sure", F.floor(rate).cast("bigint"))
        .withColumn("part", rate - F.floor(rate))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    )
    room = F.col("size") * F.lit(_ONE)
    identifier = F.struct(*identity, "copy", "source_size", "target", "sure")
    units = rows.withColumn(
        "unit",
        F.struct(
            (-F.col("size")).alias("order"),
            F.xxhash64("doc_id", "high", "low", "source", "copy").alias("key"),
            room.alias("room"),
            F.round(room * F.col("part")).cast("bigint").alias("mass"),
            identifier.alias("id"),
        ),
    ).select("unit")
    fixed = (F.col("unit.mass") <= 0) | (F.col("unit.mass") >= F.col("unit.room"))
    units = stored(units, "units")
    results = [units.where(fixed)]

    source = F.col("unit.id.source")
    units = units.where(~fixed).withColumns(
        {"name": source, "step": F.floor(F.log2(F.col("unit.id.size").cast("double")) * 2).cast("int")}
    )
    many = units.groupBy(F.col("name").alias("n"), F.col("step").alias("s")).agg(F.count("*").alias("many"))
    many = stored(many, "many")
    units = units.join(many, F.col("name").eqNullSafe(F.col("n")) & (F.col("step") == F.col("s")))
    buckets = F.ceil(F.col("many") / FAN)
    units = units.select("unit", "name", "step", buckets.alias("buckets")).withColumn(
        "bucket", F.pmod(F.xxhash64("unit.key"), F.col("buckets"))
    )
    most_buckets = many.agg(F.max(F.ceil(F.col("many") / FAN))).first()[0] or 0
    while most_buckets:
        level = stored(_round(units, "name", "step", "buckets", "bucket"), "level")
        results.append(level.select(F.explode("done").alias("unit")))
        fewer = F.ceil(F.col("buckets") / FAN)
        units = level.select(F.col("open").alias("unit"), "name", "step", fewer.alias("buckets"), F.pmod("bucket", fewer).alias("bucket"))
        if most_buckets == 1:
            break
        most_buckets = -(-most_buckets // FAN)
    last = stored(_round(units, "name"), "last")
    results.append(last.select(F.explode("done").alias("unit")))
    results.append(last.select(F.col("open").alias("unit")))
    decided = results[0]
    for more in results[1:]:
        decided = decided.unionByName(more)
    extra = F.when((F.col("unit.mass") > 0) & (F.col("unit.mass") * 2 >= F.col("unit.room")), 1).otherwise(0)
    return decided.select("unit.id.*", (F.col("unit.id.sure") + extra).alias("copies")).select(
        *identity, "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as they are taken, all columns kept.

    Rows that agree in doc_id, source and text count as one with all their copies; their other
    columns are those of one of them.
    """
    identity = ["id_null", "id", "source_null", "name", "high", "low"]

    def named(doc_id: Column, source: Column, high: Column, low: Column) -> list[Column]:
        doc_id, none, empty = doc_id.cast("bigint"), F.lit(0), F.lit("")
        columns = [doc_id.isNull(), F.coalesce(doc_id, none), source.isNull(), F.coalesce(source, empty), high, low]
        return [c.alias(n) for c, n in zip(columns, identity)]

    taken = copies(docs, **how).where("copies > 0")
    taken = taken.select("copies", *named(*(F.col(c) for c in ("doc_id", "source", "high", "low"))))
    taken = taken.groupBy(*identity).agg(F.sum("copies").cast("int").alias("copies"))
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    given = given.select("row", text_key(F.col("row.text")).alias("k"))
    given = given.select("row", *named(F.col("row.doc_id"), F.col("row.source"), F.col("k.high"), F.col("k.low")))
    one = given.groupBy(*identity).agg(F.first("row").alias("row"))
    repeated = one.join(taken, identity).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")
