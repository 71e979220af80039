"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source's target is a share of ``BUDGET`` times all words by weight, at most ``CAP`` times
its own words; what is above goes to the others by weight.  A document of a source is
due ``rate = target / size of the source`` copies: the whole part for sure, the fraction as a
probability.  Fractions become 0 or 1 by moving probability mass (in words) between
pairs until one side of a pair is integral, with odds that keep every expectation and
every total:

* leaves: a source's documents are dealt out by hash to groups of about ``LEAF``.  Within a group the
  largest document is paired with all smaller ones as one bundle of equal fractions, then
  the next largest, so what is left over is small;
* tree: each group's one fractional document goes up; ``LEAF`` of them at a time are paired until one
  is left for each source, in as many levels as the number of groups needs;
* root: the last one is rounded by its own probability.

A source's words taken so differ from its target by less than one document's size.  Random
numbers are hashes of ids, so reruns agree.

Defined results: a NULL or empty text has size zero and takes nothing; a NULL source is a source, the last
in order; repeated rows are documents of their own, told apart by a counter; without
words every target is zero; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftline.operators.numbering import numbered
from thriftline.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
LEAF = 128
_EPS = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, k)``: one row a document, ``k`` counting rows alike."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    alike = docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    return alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("k"))


def targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """``(source, source_size, n, target)``, one row a source.

    The level, words per unit of weight among the sources below their cap, is found by the rule
    itself: share, cap what is above, share again; each round is one aggregate.
    """
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    placed = numbered(sizes, [], [F.col("source").asc_nulls_last()])
    turn = F.pmod(F.col("position") - 1, F.lit(len(weights))).cast("int") + 1
    weighed = written(placed.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn)), "sources")
    level = -1.0
    while True:
        above = F.col("w") * F.lit(level) > F.col("source_size") * F.lit(cap)
        found = weighed.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("capped"),
            F.sum(F.when(~above, F.col("w"))).alias("open"),
        ).first()
        raised = (budget * (found["all"] or 0) - cap * found["capped"]) / found["open"] if found["open"] else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("source_size") * F.lit(cap), F.col("w") * F.lit(max(level, 0.0)))
    return written(weighed.select("source", "source_size", "n", target.cast("double").alias("target")), "targets")


def _uniform(salt: str) -> Column:
    """In [0, 1), from a document's id and counter."""
    return F.pmod(F.xxhash64("doc_id", "k", "size", F.lit(salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _settled(p: Column) -> Column:
    return F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p)


_MADE = "array<struct<doc_id:bigint,k:bigint,size:bigint,p:double>>"


def _leaf(items: Column, words: Column, share: Column) -> Column:
    """Settle documents, largest first, each against the bundle of the ones after it.

    The state is the words and the probability mass of the bundle that is left.
    """

    def step(state: Column, item: Column) -> Column:
        size = (-item["neg_size"]).cast("double")
        q = F.when(state["words"] > 0, state["mass"] / state["words"]).otherwise(F.lit(0.0))
        rest = state["words"] - size
        up, down = F.least((1 - q) * size, q * rest), F.least(q * size, (1 - q) * rest)
        moved = F.when(item["u"] * (up + down) < down, up).otherwise(-down)
        p = F.when(size > 0, _settled(q + moved / size)).otherwise((item["u"] < share).cast("double"))
        made = F.struct(item["doc_id"].alias("doc_id"), item["k"].alias("k"), (-item["neg_size"]).alias("size"), p.alias("p"))
        return F.struct(
            rest.alias("words"),
            F.greatest(F.lit(0.0), F.least(rest, q * rest - moved)).alias("mass"),
            F.concat(state["made"], F.array(made)).cast(_MADE).alias("made"),
        )

    start = F.struct(
        words.cast("double").alias("words"), (words * share).alias("mass"), F.array().cast(_MADE).alias("made")
    )
    return F.aggregate(items, start, step, lambda state: state["made"])


def _node(items: Column) -> Column:
    """Pair fractional documents one after the other; one at most stays fractional."""
    kind = "struct<doc_id:bigint,k:bigint,size:bigint,p:double>"

    def step(state: Column, item: Column) -> Column:
        held = state["held"]
        a, b = held["size"].cast("double"), (-item["neg_size"]).cast("double")
        up, down = F.least((1 - held["p"]) * a, item["p"] * b), F.least(held["p"] * a, (1 - item["p"]) * b)
        moved = F.when(item["u"] * (up + down) < down, up).otherwise(-down)
        pa = F.when(held.isNull(), F.lit(None).cast("double")).otherwise(_settled(held["p"] + moved / a))
        pb = F.when(held.isNull(), item["p"]).otherwise(_settled(item["p"] - moved / b))
        old = F.struct(held["doc_id"].alias("doc_id"), held["k"].alias("k"), held["size"].alias("size"), pa.alias("p"))
        new = F.struct(item["doc_id"].alias("doc_id"), item["k"].alias("k"), (-item["neg_size"]).alias("size"), pb.alias("p"))
        open_new = (pb > 0) & (pb < 1)
        open_old = F.coalesce((pa > 0) & (pa < 1), F.lit(False))
        both = F.concat(
            F.when(held.isNull() | open_old, F.array().cast(_MADE)).otherwise(F.array(old).cast(_MADE)),
            F.when(open_new, F.array().cast(_MADE)).otherwise(F.array(new).cast(_MADE)),
        )
        return F.struct(
            F.when(open_new, new.cast(kind)).when(open_old, old.cast(kind)).otherwise(F.lit(None).cast(kind)).alias("held"),
            F.concat(state["made"], both).cast(_MADE).alias("made"),
        )

    start = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast(_MADE).alias("made"))
    return F.aggregate(
        items,
        start,
        step,
        lambda state: F.when(state["held"].isNull(), state["made"]).otherwise(
            F.concat(state["made"], F.array(state["held"]).cast(_MADE))
        ),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, k, source, size, source_size, target, copies, taken)``, one row a document."""
    items = written(sized(docs), "sizes")
    goals = targets(items, weights, budget, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = goals.select(
        F.col("source").alias("_source"), "source_size", "target", rate.alias("rate"),
        F.floor(rate).cast("int").alias("whole"), F.ceil(F.col("n") / leaf).alias("groups"),
    )
    keys = ["source", "source_size", "target", "rate", "whole"]
    due = items.join(rated, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "k", "size", F.lit("group")), F.col("groups"))
    )
    item = F.struct((-F.col("size")).alias("neg_size"), _uniform("leaf").alias("u"), "doc_id", "k")
    made = due.groupBy(*keys, "_group").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("size").alias("words"))
    state = made.select(*keys, F.explode(_leaf(F.col("items"), F.col("words"), F.col("rate") - F.col("whole"))).alias("_m"))
    now = written(state.select(*keys, "_m.*"), "mixed")
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    done = now.where(~fractional)
    largest = goals.agg(F.max("n")).first()[0] or 0
    groups = math.ceil(largest / leaf)
    level = 0
    while groups > 1:
        groups, level = math.ceil(groups / leaf), level + 1
        item = F.struct((-F.col("size")).alias("neg_size"), _uniform(f"level {level}").alias("u"), "doc_id", "k", "p")
        dealt = F.pmod(F.xxhash64("doc_id", "k", "size", F.lit(f"group {level}")), F.lit(groups))
        paired = now.where(fractional).groupBy(*keys, dealt.alias("_group")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        now = written(paired.select(*keys, F.explode(_node(F.col("items"))).alias("_m")).select(*keys, "_m.*"), "mixed")
        done = done.unionByName(now.where(~fractional))
    last = now.where(fractional).withColumn("p", (_uniform("root") < F.col("p")).cast("double"))
    copies = F.col("whole") + F.col("p").cast("int")
    return done.unionByName(last).select(
        "doc_id", "k", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with all its columns."""
    drawn = written(mixed(docs, weights, budget, cap), "drawn")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", size.alias("size"))
    several = drawn.where("k > 1")
    one = drawn.where("k = 1") if several.isEmpty() else _unrepeated(drawn)
    name = F.struct("doc_id", "source", "size")
    # A name has some 180 bytes in memory and 9 in its file, by which Spark would broadcast it.
    found = rows.withColumn("_name", name).drop("doc_id", "source", "size").join(
        one.select(name.alias("_name"), "copies").hint("merge"), "_name"
    )
    taken = found.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_row.*")
    if several.isEmpty():
        return taken
    alike = several.select(name.alias("_name")).distinct().hint("merge")
    # Rows alike are told apart by their texts' order; which of equal ones is first makes no difference.
    counted = (
        rows.withColumn("_name", name).drop("doc_id", "source", "size").join(alike, "_name", "left_semi")
        .withColumn("k", F.row_number().over(Window.partitionBy("_name").orderBy(F.xxhash64("_row.text"))).cast("bigint"))
        .join(drawn.select(name.alias("_name"), "k", "copies").hint("merge"), ["_name", "k"])
    )
    return taken.unionByName(
        counted.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_row.*")
    )


def _unrepeated(drawn: DataFrame) -> DataFrame:
    keys = ["doc_id", "source", "size"]
    alone = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("copies"))
    return alone.where("n = 1").drop("n")
