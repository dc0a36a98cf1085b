"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Only DataFrame functions. Each source's documents are dealt by hash into blocks
of about equal words. A source's target is turned into an exact quota of block
draws: as many whole rounds over its blocks as fit, then blocks of one more
round (of documents no larger than what is left), the last of which is cut
where the target is reached. A binary tree over
the output shards splits the quota vector: at a node with L of M shards on the
left, the left part is a multivariate-hypergeometric draw, source after source,
each by the inverse of its distribution. A leaf's quotas are intervals on the
source's permuted draws, so shards get disjoint blocks. Documents join their
block's draws; within a shard rows are ordered by a hash.

What a document costs is a few small columns; only ``mix`` moves texts, and it
moves them once, to their shard. Block totals are summed before they are
ordered, a source has at most ``MAX_BLOCKS`` blocks (which then grow), so one
source with most rows is spread over its blocks.

Edge cases: null text has size 0; a null source is a source of its own, sorted
last; a source without words has target 0; documents of no words are never
taken, except that nothing stops a shard from being empty; documents equal in
doc_id share their place in the permutation and are taken together; empty
tables give no rows. All draws follow from hashes, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

WEIGHTS = (5, 2, 1)
#: Most times that a document is taken.
MOST = 3
BLOCK_WORDS, SHARD_WORDS, MAX_BLOCKS, MAX_SHARDS = 1 << 15, 1 << 18, 1 << 14, 1 << 12
#: Multiplier of the permutation of draws: a prime above any number of draws.
PRIME = 2_147_483_647


#: Documents, at most, that a source adds to its blocks or takes out of them to come nearer to its target.
FILLERS = 3
#: Rows up to which a side is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def hypergeometric(marked: Column, rest: Column, drawn: Column, u: Column) -> Column:
    """A draw of how many of ``drawn`` items, of ``marked + rest``, are marked; u is uniform.

    Weights relative to the mode are enumerated outwards from it over ten
    standard deviations either way, beyond which they are below any double.
    """
    def ranges(a: Column) -> Column:
        total = a["marked"] + a["rest"]
        low, high = F.greatest(F.lit(0), a["drawn"] - a["rest"]), F.least(a["marked"], a["drawn"])
        mode = F.floor((a["drawn"] + 1.0) * (a["marked"] + 1.0) / (total + 2.0))
        spread = F.when(total > 1, a["drawn"] * (a["marked"] / total) * (a["rest"] / total) * ((total - a["drawn"]) / (total - 1.0))).otherwise(F.lit(0.0))
        return F.struct(F.least(high, F.greatest(low, mode)).cast("bigint").alias("mode"), low.alias("low"), high.alias("high"), (F.ceil(10 * F.sqrt(spread)) + 10).alias("reach"))

    def walk(a: Column, r: Column, up: bool, start: Column, goal: Column) -> Column:
        """(weight, sum, value): value is the first whose running sum passes ``goal``."""
        steps = F.least(r["reach"], (r["high"] - r["mode"]) if up else (r["mode"] - r["low"])).cast("bigint")
        first = F.struct(F.lit(1.0).alias("w"), start.alias("sum"), F.lit(None).cast("bigint").alias("value"))

        def merge(s: Column, i: Column) -> Column:
            k = r["mode"] + i if up else r["mode"] - i
            if up:
                w = s["w"] * (a["marked"] - k + 1.0) * (a["drawn"] - k + 1.0) / (k * (a["rest"] - a["drawn"] + k + 0.0))
            else:
                w = s["w"] * (k + 1.0) * (a["rest"] - a["drawn"] + k + 1.0) / ((a["marked"] - k + 0.0) * (a["drawn"] - k + 0.0))
            return let(w, lambda x: F.struct(x.alias("w"), (s["sum"] + x).alias("sum"), F.when(s["value"].isNull() & (s["sum"] + x > goal), k).otherwise(s["value"]).cast("bigint").alias("value")))

        return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(F.array().cast("array<bigint>")), first, merge)

    def chosen(a: Column, r: Column) -> Column:
        never = F.lit(float("inf"))
        sums = F.struct(walk(a, r, True, F.lit(1.0), never)["sum"].alias("up"), walk(a, r, False, F.lit(0.0), never)["sum"].alias("down"))

        def pick(t: Column) -> Column:
            above = walk(a, r, True, F.lit(1.0), t["goal"])["value"]
            below = walk(a, r, False, t["up"], t["goal"])["value"]
            return F.when(t["goal"] < 1.0, r["mode"]).otherwise(F.coalesce(above, below, r["mode"]))

        return let(sums, lambda t: let(F.struct(t["up"].alias("up"), (a["u"] * (t["up"] + t["down"])).alias("goal")), pick))

    given = F.struct(marked.cast("bigint").alias("marked"), rest.cast("bigint").alias("rest"), drawn.cast("bigint").alias("drawn"), u.alias("u"))
    return let(given, lambda a: let(ranges(a), lambda r: chosen(a, r)))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row (source_no, shard, first, n) for each source that has draws in a shard.

    ``quotas`` has (source_no, draws). Nodes are rows with the quota vector;
    every level halves their shards and sends a hypergeometric draw to the left.
    """
    node = quotas.orderBy("source_no").groupBy().agg(F.sort_array(F.collect_list(F.struct("source_no", F.col("draws").alias("n")))).alias("q"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q", F.transform("q", lambda _: F.lit(0).cast("bigint")).alias("first"))
    while_levels = max(0, (shards - 1).bit_length())
    for level in range(while_levels):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
        share = F.floor(total * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("bigint")
        begin = F.struct(total.alias("left"), share.alias("drawn"), F.array().cast("array<bigint>").alias("out"))

        def draw(s: Column, x: Column) -> Column:
            u = uniform(F.lit(seed), F.lit(level), F.col("lo"), x["source_no"])
            return let(hypergeometric(x["n"], s["left"] - x["n"], s["drawn"], u), lambda got: F.struct((s["left"] - x["n"]).alias("left"), (s["drawn"] - got).alias("drawn"), F.concat(s["out"], F.array(got)).alias("out")))

        # materialized as a column, so that both children use one draw
        node = node.withColumn("mid", mid).withColumn("got", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("q", begin, draw)["out"]))
        left = F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.transform("q", lambda x, i: F.struct(x["source_no"].alias("source_no"), F.get("got", i).alias("n"))).alias("q"), F.col("first").alias("first"))
        right = F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.transform("q", lambda x, i: F.struct(x["source_no"].alias("source_no"), (x["n"] - F.get("got", i)).alias("n"))).alias("q"), F.zip_with("first", "got", lambda a, b: a + b).alias("first"))
        same = F.struct("lo", "hi", "q", "first")
        node = node.select(F.explode(F.when(F.col("got").isNull(), F.array(same)).otherwise(F.array(left, right))).alias("x")).select("x.*")
        if level % 3 == 2:
            node = cut(node.repartition(min(64, 1 << level + 1), "lo"))
    leaf = node.select(F.col("lo").alias("shard"), F.posexplode("q").alias("i", "x"), "first")
    return leaf.select("x.source_no", "shard", F.get("first", F.col("i")).alias("first"), F.col("x.n").alias("n")).where("n > 0")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with source_no and target: shares by weight, none above ``most`` sizes.

    A source is full if the level (words a unit of weight) is at least
    most * size / weight, so in order of that ratio the full ones come first.
    """
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    listed = sizes.withColumn("source_no", F.row_number().over(by_code) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    filled = listed.withColumn("weight", weight).withColumn("ratio", F.col("source_size") * float(most) / F.col("weight"))
    order = Window.orderBy("ratio", "source_no")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - float(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    marked = filled.withColumn("level", level).withColumn("open", F.col("ratio") >= F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct("ratio", "source_no", "level"))).over(whole)["level"]
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("source_size") * float(most), F.col("weight") * F.coalesce(final, F.lit(float("inf")))))
    return marked.select("source", "source_no", "source_size", target.alias("target"))


class Plan:
    """What a mix takes: per source, per block draw, and the line that cuts the last blocks."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS):
        self.seed = seed
        self.rows = cut(docs.select(F.col("doc_id"), F.col("source"), n_words(text_of()).alias("size"), self.place().alias("place")))
        sizes = cut(targets(self.rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
        self.n_sources, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
        self.shards = min(MAX_SHARDS, max(1, -(-total // shard_words)))
        blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))).cast("bigint")
        full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
        sources = sizes.select("*", blocks.alias("blocks"), full.alias("rounds"))
        sources = sources.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
        # blocks in order, with the words before them, of documents that can fit into what is left
        dealt = self._with(self.rows.where("size > 0"), sources.select("source", "source_no", "blocks", "rest")).where(F.col("size") <= F.col("rest"))
        words = dealt.groupBy("source_no", self.block().alias("block")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source_no").orderBy("block"))
        line = words.withColumn("before", upto - F.col("words"))
        cuts = line.join(sources.select("source_no", "rest"), "source_no").where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        cuts = cuts.select("source_no", F.col("block").alias("cut_block"), (F.col("rest") - F.col("before")).alias("cut_words"))
        # in the block that is cut, documents by place, as far as they fit
        inside = self._with(self.rows.where("size > 0"), sources.join(cuts, "source_no").select("source", "source_no", "blocks", "rest", "cut_block", "cut_words")).where((self.block() == F.col("cut_block")) & (F.col("size") <= F.col("rest")))
        same = inside.groupBy("source_no", "place", "cut_words").agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("source_no").orderBy("place"))
        fits = same.withColumn("run", run).where(F.col("run") <= F.col("cut_words")).groupBy("source_no").agg(F.max("place").alias("cut_place"), F.max("run").alias("fit_words"))
        fitting = words.groupBy("source_no").agg(F.sum("words").alias("fitting"))
        every = sources.join(cuts, "source_no", "left").join(fits, "source_no", "left").join(fitting, "source_no", "left")
        # without a cut all that fits is taken: the cut lies behind the last block
        gap = F.when(F.col("cut_block").isNotNull(), F.col("cut_words") - F.coalesce("fit_words", F.lit(0))).otherwise(F.col("rest") - F.coalesce("fitting", F.lit(0)))
        self.sources = cut(every.withColumn("gap", gap.cast("double")).withColumn("cut_block", F.coalesce("cut_block", "blocks")))
        # places to add, or to leave out again, whose documents come closest to what is left
        none = F.array().cast("array<bigint>")
        self.sources = self.sources.withColumn("fill_places", none).withColumn("drop_places", none)
        wanted, size = F.abs(F.col("gap")), F.col("size")
        for _ in range(FILLERS):
            able = F.when(F.col("gap") > 0, ~self.extra_round() & ~F.array_contains("fill_places", F.col("place"))).otherwise(self.extra_round())
            left = self._with(self.rows.where("size > 0"), self.sources.where("gap <> 0")).where(able)
            sums = left.groupBy("source_no", "place", "gap").agg(F.sum("size").alias("size")).where(F.abs(size - wanted) < wanted)
            nearest = sums.groupBy("source_no").agg(F.min_by(F.struct("place", "size"), F.struct(F.abs(size - wanted), "place")).alias("fill"))
            filled = self.sources.join(nearest, "source_no", "left")
            more, less = F.col("fill").isNotNull() & (F.col("gap") > 0), F.col("fill").isNotNull() & (F.col("gap") < 0)
            change = F.when(more, F.col("fill.size")).when(less, -F.col("fill.size")).otherwise(0)
            filled = filled.withColumns({"fill_places": F.when(more, F.array_append("fill_places", F.col("fill.place"))).otherwise(F.col("fill_places")), "drop_places": F.when(less, F.array_append("drop_places", F.col("fill.place"))).otherwise(F.col("drop_places")), "gap": F.col("gap") - change})
            self.sources = cut(filled.drop("fill"))
        draws = F.col("rounds") * F.col("blocks") + F.when(F.col("rest") > 0, F.least(F.col("cut_block") + 1, F.col("blocks"))).otherwise(0)
        quotas = self.sources.select("source_no", "blocks", draws.alias("draws"))
        leaves = split_tree(quotas.select("source_no", "draws"), self.shards, seed).where("n > 0")
        each = leaves.select("source_no", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
        draw = F.pmod(F.col("at") * F.lit(PRIME) + F.pmod(F.xxhash64(F.lit(seed), "source_no"), F.lit(1 << 20)), F.col("draws"))
        numbered = each.join(quotas, "source_no").withColumn("draw", draw)
        self.draws = cut(numbered.groupBy("source_no", F.pmod("draw", "blocks").alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.floor(F.col("draw") / F.col("blocks")).cast("int").alias("round"), "shard"))).alias("drawn")))
        self.n_blocks = self.draws.count()

    def place(self) -> Column:
        """Where a document stands in its source's permutation: block by the high part, order by all."""
        return F.xxhash64(F.lit(self.seed), F.lit("place"), "doc_id")

    @staticmethod
    def block() -> Column:
        return F.pmod("place", "blocks")

    @staticmethod
    def extra_round() -> Column:
        """Whether the last, partial round takes a document by its place."""
        earlier = Plan.block() < F.col("cut_block")
        fits = (F.col("size") <= F.col("rest")) & ~F.array_contains("drop_places", F.col("place"))
        return F.coalesce(fits & (earlier | ((Plan.block() == F.col("cut_block")) & (F.col("place") <= F.col("cut_place")))), F.lit(False))

    def _with(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        other = sources.withColumnRenamed("source", "__source")
        return rows.join(bounded(other, self.n_sources), rows["source"].eqNullSafe(other["__source"])).drop("__source")

    def taken(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with source, place) and source_no, source_size, target, drawn: (round, shard) of each time."""
        known = self._with(rows, self.sources.select("source", "source_no", "source_size", "target", "blocks", "rounds", "rest", "cut_block", "cut_place", "fill_places", "drop_places"))
        keyed = known.withColumn("block", self.block())
        joined = keyed.join(bounded(self.draws.withColumnRenamed("source_no", "__no").withColumnRenamed("block", "__block"), self.n_blocks), (F.col("source_no") == F.col("__no")) & (F.col("block") == F.col("__block")), "left")
        used = F.filter(F.coalesce("drawn", F.array().cast(self.draws.schema["drawn"].dataType)), lambda d: (d["round"] < F.col("rounds")) | self.extra_round())
        spare = F.when(F.array_contains("fill_places", F.col("place")), F.array(F.struct(F.col("rounds").cast("int").alias("round"), F.pmod(F.xxhash64("source_no", "place"), F.lit(self.shards)).cast("int").alias("shard")))).otherwise(F.array().cast(self.draws.schema["drawn"].dataType))
        return joined.withColumn("drawn", F.when(F.col("size") > 0, F.concat(used, spare)).otherwise(F.array().cast(self.draws.schema["drawn"].dataType)))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target of its source, taken (words, repeats counted), shards it goes to."""
    plan = Plan(docs, **options)
    return plan.taken(plan.rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("drawn")).cast("bigint").alias("taken"), F.transform("drawn", lambda d: d["shard"]).alias("shards"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with their own columns, as often as taken, shard by shard in a local shuffle."""
    columns, plan = docs.columns, Plan(docs, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), "source", n_words(text_of()).alias("size"), plan.place().alias("place"))
    out = plan.taken(rows).select("__row", "place", F.explode("drawn").alias("__d"))
    placed = out.repartition(plan.shards, "__d.shard").sortWithinPartitions("__d.shard", F.xxhash64(F.lit(plan.seed), "place", "__d.round"))
    return placed.select("__row.*")
