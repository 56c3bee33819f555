"""Candidate pairs: facts of different documents that are about the same thing.

Facts meet by comparison key. For two documents under one key, if they share a predicate, only facts of shared predicates are paired, the closest compatible pair of each; if they share none, all compatible pairs are.

Nearly all keys have few facts. These are brought together by key once, whole, and paired within a row. Which keys have more than SMALL facts is counted on hashes of keys alone; facts of these go the long way:

- Everything up to the pairs of ids runs on a narrow table (key, document, predicate, type, number, order); whole facts are fetched by id at the end.
- Documents meet by key. A key that many documents have is dealt over a grid of cells, rows on one side and columns on the other, by its frequency in a sketch of bounded size, so no task holds a hot key alone.
- The closest pair of two short lists of numbers is found within a row that holds both. Longer lists are never compared pair by pair: both sides' numbers are sorted together, and the nearest number of the other side is the one below, the one above or, with the sign changed, the greatest or the least. Ranges of numbers are sorted apart, each with the nearest numbers of the ranges beside it, so a long list is dealt over tasks.
- Where two documents share no predicate, pairs of ids are made in blocks of each document's facts.

One order of facts decides orientation and ties: file name, page, id.

Cases with a defined result: facts without an id, subject, predicate or document are in no pair; a missing type is compatible with unknown only; a missing number is at distance 0 of everything, one that is not finite at no distance that could be smaller than another; rows that repeat are one fact, rows that share nothing but the id are facts of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.naming import comparison_key
from factloom.operators.shared import made_once

#: Numbers of one document, key and predicate up to which pairs are compared within a row.
SMALL = 64
#: Documents of a cell of the grid, cells of the sketch of keys, and how much commoner than the mean a cell is before its keys are dealt.
CELL, SKETCH, HOT = 256, 1 << 16, 16
#: Facts of a block.
BLOCK = 1000
GROUP = ("_key", "pred", "da", "db")


def compatible(a: Column, b: Column) -> Column:
    """Value types that can be compared."""
    money = a.isin("numeric", "currency") & b.isin("numeric", "currency")
    return (a == b) | (a == "unknown") | (b == "unknown") | money


def _apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def distance(a: Column, b: Column) -> Column:
    """Relative distance of two numbers, the divisor at least 1; 0 if one is missing."""
    return F.coalesce(_apart(a, b), F.lit(0.0))


def _fits(a: Column, b: Column) -> Column:
    """As compatible(), of types of which numbers and amounts of money are one."""
    return F.coalesce((a == b) | (a == "unknown") | (b == "unknown"), F.lit(False))


def _kind(c: Column) -> Column:
    return F.when(c.isin("numeric", "currency"), F.lit("number")).otherwise(c)


def _tag(facts: DataFrame) -> Column:
    """A hash of the row but for its key, which is made anew: it tells facts of one id apart."""
    return F.xxhash64(*(c for c in facts.columns if c != "comparison_key")).alias("tag")


def _given(facts: DataFrame) -> DataFrame:
    """Facts that can be in a pair. The key is null where subject or predicate is; asked of the key, it would be computed once more."""
    return facts.filter("id is not null and subject is not null and predicate is not null and source_document_id is not null")


def narrow(facts: DataFrame) -> DataFrame:
    """What pairing needs of each fact."""
    return _given(facts).select(
        comparison_key(F.col("subject"), F.col("predicate")).alias("_key"),
        F.col("source_document_id").alias("doc"),
        F.col("predicate").alias("pred"),
        _kind(F.col("value_type")).alias("kind"),
        F.col("norm_num").alias("num"),
        F.struct("source_filename", "page_number", "id", _tag(facts)).alias("at"),
    )


def dealt(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """Adds grid: over how many rows and columns of cells the documents of a key are dealt. One row of a count-min sketch of the keys tells; its counts are never too small."""
    b = F.pmod(F.xxhash64("_key"), F.lit(SKETCH))
    counts = docs.groupBy(b.alias("b")).count().collect()  # SKETCH rows at most
    limit = max(cell, HOT * sum(r["count"] for r in counts) / SKETCH)
    hot = [(r["b"], -(-r["count"] // cell)) for r in counts if r["count"] > limit]
    if not hot:
        return docs.withColumn("grid", F.lit(1))
    sketch = docs.sparkSession.createDataFrame(hot, "b long, cells long")
    return docs.withColumn("b", b).join(F.broadcast(sketch), "b", "left").withColumn("grid", F.coalesce("cells", F.lit(1)).cast("int")).drop("b", "cells")


def met(docs: DataFrame) -> DataFrame:
    """Pairs of documents under a key, the first one first, with the predicates that they share. docs: _key, doc, first, preds, n and grid."""
    own, every = F.pmod(F.hash("doc"), F.col("grid")), F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    x = docs.select("_key", own.alias("row"), F.col("doc").alias("da"), F.col("first").alias("fa"), F.col("preds").alias("pa"), F.col("n").alias("na"), every.alias("col"))
    y = docs.select("_key", own.alias("col"), F.col("doc").alias("db"), F.col("first").alias("fb"), F.col("preds").alias("pb"), F.col("n").alias("nb"), every.alias("row"))
    before = (F.col("fa") < F.col("fb")) | ((F.col("fa") == F.col("fb")) & (F.col("da") < F.col("db")))
    return x.join(y, ["_key", "row", "col"]).filter(before).select("_key", "da", "db", "na", "nb", F.array_intersect("pa", "pb").alias("shared"))


def _closest_in_row(pairs: DataFrame) -> DataFrame:
    """Ids of the closest compatible pair of two short lists."""
    ranked = F.flatten(F.transform("va", lambda x: F.transform(F.filter("vb", lambda y: _fits(x["kind"], y["kind"])), lambda y: F.struct(distance(x["num"], y["num"]).alias("d"), x["at"].alias("ata"), y["at"].alias("atb")))))
    return pairs.select("_key", F.array_min(ranked).alias("best")).filter("best is not null").select("_key", "best.ata", "best.atb")


def _sides(groups: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = groups.join(values.withColumnRenamed("doc", "da"), ["_key", "pred", "da"])
    b = groups.join(values.withColumnRenamed("doc", "db"), ["_key", "pred", "db"])
    return a.select(*GROUP, "kind", "num", "at"), b.select(*GROUP, "kind", "num", "at")


def closest_by_sorting(groups: DataFrame, values: DataFrame, kinds: list[str]) -> DataFrame:
    """Ids of the closest compatible pair of each group, whatever the lengths of its lists.

    Types meet in arenas, one for each type: unknown is in all of them, a missing type in one of its side's own, so all that meet in an arena is compatible. Ties: of the first facts at the least distance the first by order, then of the second facts at that distance of it."""
    a, b = _sides(groups, values)
    every = F.array(*(F.lit(k) for k in [*kinds, "<", ">"]))
    arena = lambda side: F.explode(F.when(F.col("kind") == "unknown", every).otherwise(F.array(F.coalesce("kind", F.lit(side))))).alias("arena")
    rows = a.select(*GROUP, arena("<"), F.lit(0).alias("side"), "kind", "num", "at").unionByName(b.select(*GROUP, arena(">"), F.lit(1).alias("side"), "kind", "num", "at"))
    finite = F.col("num").isNotNull() & (F.abs("num") < float("inf"))
    odd = F.col("num").isNotNull() & ~finite
    place = (*GROUP, "arena")

    # Distances that need no search: 0 where a number is missing, and not a number where one is not finite.
    first = lambda side, which: F.min(F.when((F.col("side") == side) & which, F.col("at")))
    which = {"any": F.lit(True), "none": F.col("num").isNull(), "some": F.col("num").isNotNull(), "odd": odd}
    least = rows.groupBy(*place).agg(*(first(side, c).alias(f"{n}{side}") for n, c in which.items() for side in (0, 1)))
    told = [(0.0, "none0", "any1"), (0.0, "any0", "none1"), (float("nan"), "odd0", "some1"), (float("nan"), "some0", "odd1")]
    cases = F.array(*(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.lit(d).alias("d"), F.col(x).alias("ata"), F.col(y).alias("atb"))) for d, x, y in told))
    easy = least.select(*GROUP, F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c"))

    # Ranges of numbers, in their order; each gets what lies nearest outside it, and the extremes.
    numbers = rows.filter(finite).withColumn("range", F.floor(F.signum("num") * F.log2(1 + F.abs("num")) * 64))
    other = F.when(F.col("side") == 1, F.col("num"))
    ranges = numbers.groupBy(*place, "range").agg(F.min(other).alias("low"), F.max(other).alias("high"), F.min("side").alias("side"))
    in_order = Window.partitionBy(*place).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reverse = Window.partitionBy(*place).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*place)
    beside = F.array(F.max("high").over(in_order), F.min("low").over(reverse), F.min("low").over(whole), F.max("high").over(whole))
    guests = ranges.withColumn("num", beside).filter("side = 0").select(*place, "range", F.lit(1).alias("side"), F.explode(F.array_distinct("num")).alias("num")).filter("num is not null")
    both = numbers.select(*place, "range", "side", "num", "kind", "at").unionByName(guests, allowMissingColumns=True)
    part = Window.partitionBy(*place, "range")
    nearest = [
        F.last(other, ignorenulls=True).over(part.orderBy("num", F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)),
        F.last(other, ignorenulls=True).over(part.orderBy(F.desc("num"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)),
        F.min(other).over(part),
        F.max(other).over(part),
    ]
    found = both.withColumns({f"near{i}": c for i, c in enumerate(nearest)}).filter("side = 0 and near2 is not null")
    d = F.least(*(_apart(F.col("num"), F.col(f"near{i}")) for i in range(4)))
    best = found.groupBy(*GROUP).agg(F.min(F.struct(d.alias("d"), F.col("at").alias("ata"), "num", "kind")).alias("x"))
    second = b.filter(finite).join(best, list(GROUP)).filter(_fits(F.col("x.kind"), F.col("kind")) & (_apart(F.col("x.num"), F.col("num")) == F.col("x.d")))
    searched = second.groupBy(*GROUP).agg(F.min("x").alias("x"), F.min("at").alias("atb")).select(*GROUP, F.struct("x.d", "x.ata", "atb").alias("c"))
    return easy.unionByName(searched).groupBy(*GROUP).agg(F.min("c").alias("c")).select("_key", "c.ata", "c.atb")


def pairs_of_ids(facts: DataFrame, small: int = SMALL) -> DataFrame:
    """_key, ata and atb (file name, page and id of both facts) of all candidate pairs."""
    n = made_once(narrow(facts))
    # Of equal numbers only the first fact can be in the closest pair, so tasks add up their own before anything moves.
    values = n.groupBy("_key", "doc", "pred", "kind", "num").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    of_list = Window.partitionBy("_key", "doc", "pred")
    sized = values.withColumn("size", F.count("*").over(of_list))
    short = F.collect_list(F.when(F.col("size") <= small, F.struct("kind", "num", "at")))
    lists = made_once(sized.groupBy("_key", "doc", "pred").agg(F.first("size").alias("size"), F.min("at").alias("first"), F.sum("n").alias("n"), short.alias("v")))
    docs = lists.groupBy("_key", "doc").agg(F.min("first").alias("first"), F.collect_set("pred").alias("preds"), F.sum("n").alias("n"))
    meet = met(dealt(docs))
    exact = meet.select("_key", F.explode("shared").alias("pred"), "da", "db")
    side = lambda x: lists.select("_key", "pred", F.col("doc").alias(f"d{x}"), F.col("size").alias(f"s{x}"), F.col("v").alias(f"v{x}"))
    listed = exact.join(side("a"), ["_key", "pred", "da"]).join(side("b"), ["_key", "pred", "db"])
    found = _closest_in_row(listed.filter((F.col("sa") <= small) & (F.col("sb") <= small)))
    if lists.filter(F.col("size") > small).limit(1).count():
        kinds = [r["kind"] for r in n.select("kind").distinct().collect() if r["kind"]]  # value types: a handful
        found = found.unionByName(closest_by_sorting(listed.filter((F.col("sa") > small) | (F.col("sb") > small)).select(*GROUP), values, kinds))
    return found.unionByName(_all_pairs(meet.filter(F.size("shared") == 0), n, docs))


def _all_pairs(rest: DataFrame, n: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All compatible pairs of two documents under a key, block by block."""
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    sizes = docs.filter(F.col("n") > block).select("_key", "doc", blocks("n").alias("blocks"))
    ids = n.join(sizes, ["_key", "doc"], "left").select("_key", "doc", "kind", "at", F.pmod(F.hash("at.id"), F.coalesce("blocks", F.lit(1))).alias("block")).distinct()
    cells = rest.withColumn("ba", F.explode(F.sequence(F.lit(0), blocks("na") - 1))).withColumn("bb", F.explode(F.sequence(F.lit(0), blocks("nb") - 1)))
    side = lambda x: ids.select("_key", F.col("doc").alias(f"d{x}"), F.col("block").alias(f"b{x}"), F.col("kind").alias(f"k{x}"), F.col("at").alias(f"at{x}"))
    return cells.join(side("a"), ["_key", "da", "ba"]).join(side("b"), ["_key", "db", "bb"]).filter(_fits(F.col("ka"), F.col("kb"))).select("_key", "ata", "atb")


def _by_key(facts: DataFrame) -> DataFrame:
    """Facts with their keys, which come out of a generator, so that no plan makes them twice."""
    return _given(facts).select("*", F.explode(F.array(comparison_key(F.col("subject"), F.col("predicate")))).alias("_key"))


def large_keys(facts: DataFrame, small: int = SMALL) -> DataFrame:
    """_hash of the keys of more facts than that."""
    return _by_key(facts).groupBy(F.xxhash64("_key").alias("_hash")).count().filter(F.col("count") > small).select("_hash")


def _pairs_in_row(v: Column) -> Column:
    """Pairs of one key's facts, an array of structs (doc, pred, kind, num, n) in their order, as structs of two places in it.

    A document comes first if its first fact does, so of two facts of different documents the one of the document whose first fact is at the lower place."""
    slim = F.transform(v, lambda x: F.struct(x["doc"].alias("doc"), x["pred"].alias("pred")))
    docs, lists = F.array_distinct(F.transform(slim, lambda x: x["doc"])), F.array_distinct(slim)
    preds = lambda d: F.transform(F.filter(lists, lambda x: x["doc"] == d), lambda x: x["pred"])
    # Every document with its predicates and its facts' places.
    sides = F.transform(docs, lambda d, i: F.struct(i.alias("i"), preds(d).alias("preds"), F.filter(v, lambda x: x["doc"] == d).alias("v")))
    meet = F.flatten(F.transform(sides, lambda a: F.transform(F.filter(sides, lambda b: a["i"] < b["i"]), lambda b: F.struct(a["v"].alias("a"), b["v"].alias("b"), F.array_intersect(a["preds"], b["preds"]).alias("shared")))))
    both = lambda x, y: F.struct(x["n"].alias("a"), y["n"].alias("b"))
    every = lambda m: F.flatten(F.transform(m["a"], lambda x: F.transform(F.filter(m["b"], lambda y: _fits(x["kind"], y["kind"])), lambda y: both(x, y))))
    of = lambda c, p: F.filter(c, lambda x: x["pred"] == p)
    ranked = lambda m, p: F.flatten(F.transform(of(m["a"], p), lambda x: F.transform(F.filter(of(m["b"], p), lambda y: _fits(x["kind"], y["kind"])), lambda y: F.struct(distance(x["num"], y["num"]).alias("d"), x["n"].alias("a"), y["n"].alias("b")))))
    best = lambda m: F.transform(F.filter(F.transform(m["shared"], lambda p: F.array_min(ranked(m, p))), lambda x: x.isNotNull()), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    several = F.flatten(F.transform(meet, lambda m: F.when(F.size(m["shared"]) > 0, best(m)).otherwise(every(m))))
    # Most keys have two facts: these are the pair, whether their predicates are one or not.
    x, y = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    two = F.when((x["doc"] != y["doc"]) & _fits(x["kind"], y["kind"]), F.array(both(x, y)))
    return F.when(F.size(v) == 2, two).otherwise(several)


def _within_keys(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b) of keys with few facts. Facts move once, whole, to their key's row, where they lie in their order."""
    order = ("source_filename", "page_number", "id")
    rest = [c for c in columns if c not in (*order, "comparison_key")]
    own = keyed.select("_key", F.struct(*order, _tag(keyed.drop("_key")), *rest).alias("f"))
    # Dealt before they are collected: lists of one fact each gain nothing from being made before the shuffle too.
    rows = own.repartition("_key").groupBy("_key").agg(F.collect_list("f").alias("v")).filter(F.size("v") > 1)
    rows = rows.select("_key", F.explode(F.array(F.sort_array(F.array_distinct("v")))).alias("v"))
    slim = F.transform("v", lambda x, i: F.struct(x["source_document_id"].alias("doc"), x["predicate"].alias("pred"), _kind(x["value_type"]).alias("kind"), x["norm_num"].alias("num"), i.alias("n")))
    rows = rows.select("_key", "v", F.explode(F.array(slim)).alias("s"))
    found = rows.select("_key", "v", F.explode(_pairs_in_row(F.col("s"))).alias("p"))
    found = found.select("_key", *(F.get("v", F.col(f"p.{x}")).alias(x) for x in "ab"))
    return found.select(*(F.struct(*(F.col("_key").alias(c) if c == "comparison_key" else F.col(f"{x}.{c}").alias(c) for c in columns)).alias(x) for x in "ab"))


def candidate_pairs(facts: DataFrame, small: int = SMALL) -> DataFrame:
    """Rows with two structs a and b; a is of the document that comes first under the key."""
    keyed = _by_key(facts)
    large = made_once(large_keys(facts, small))
    if not large.limit(1).count():
        return _within_keys(keyed, facts.columns)
    of_large = F.xxhash64("_key") == F.col("_hash")
    few = _within_keys(keyed.join(large, of_large, "left_anti"), facts.columns)
    return few.unionByName(pairs_of_large_keys(keyed.join(large, of_large, "left_semi").select(*facts.columns), small))


def pairs_of_large_keys(facts: DataFrame, small: int = SMALL) -> DataFrame:
    """Candidate pairs, whatever number of facts a key has; facts are fetched by id once the pairs are known."""
    ids = pairs_of_ids(facts, small).select("_key", *(F.col(f"at{x}.{c}").alias(f"_{c}{x}") for x in "ab" for c in ("id", "tag")))
    for x in "ab":
        own = [f"_id{x}", f"_tag{x}"]
        # Out of a generator the struct is opaque to the optimizer, which would otherwise derive constraints on all its fields, again and again.
        whole = facts.filter("id is not null").select(F.inline(F.array(F.struct(F.col("id").alias(own[0]), _tag(facts).alias(own[1]), F.struct(*facts.columns).alias(x)))))
        once = whole.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy(own[0]))).filter("_n = 1").drop("_n")
        ids = ids.join(once, own)
    fresh = lambda x: F.struct(*(F.col("_key").alias(c) if c == "comparison_key" else F.col(f"{x}.{c}").alias(c) for c in facts.columns)).alias(x)
    return ids.select(fresh("a"), fresh("b"))
