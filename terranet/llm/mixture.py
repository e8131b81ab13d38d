"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

All steps are DataFrame operations.

* Sizes are words.  Sources in code point order, null last, weigh 3, 1, 2 and so on;
  together they get ``share`` of all words, none more than twice its own size, and
  what a source cannot take is dealt to the others by weight.
* The documents of a source stand in the order of a hash and form blocks of about
  ``block_words`` words.  The mix takes the permuted source from its start, a second
  time where the target exceeds the source; the document at the cut is taken in part.
  So every source has an exact quota of blocks.
* Output shards are the leaves of a binary tree.  Every node holds how many blocks
  of each source it gets, and splits them between its children by drawing from the
  multivariate hypergeometric distribution: source after source, the number of its
  blocks among the left child's.  The uniform numbers behind the draws are hashes of
  seed, node and source, so reruns agree.
* A shard reads, of every source, the next blocks of the permuted order, disjoint
  from those of other shards, and its documents are ordered by a hash.

Only blocks that a target cuts need the order of their documents; all others are taken
whole or not at all.  So a document's block, which its id tells, decides what becomes of
it, and texts are shuffled once, to their shards.

Null and empty texts have no words, count for nothing and are taken 0 times.  Equal
rows are each taken on their own; rows without a doc_id are ordered by their text.  The
source with a third of all rows is no problem, as its blocks are no larger than others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terranet.llm.tables import read
from terranet.plans.ordered import sums_before
from terranet.plans.scratch import cut

WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3  # 150 %, in halves
MOST_TIMES = 2
BLOCK_WORDS = 100_000
WORD = r"[^\x20\x09-\x0D]+"
_LOG_2PI_HALF = 0.5 * math.log(2 * math.pi)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_halves: int = SHARE_HALVES, most: int = MOST_TIMES) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``, the words to take.

    A source is capped at ``most`` times its size.  In ascending order of cap per weight
    the capped sources come first: a source is capped if its fair part of what is left by
    those before it would exceed its cap.  A row per source, so one window over them is small.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "twice": share_halves * F.sum("source_size").over(everything),  # twice the words to deal out
        "capped_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    over = (F.col("twice") - 2 * F.col("capped_before")) * F.col("weight") >= 2 * F.col("cap") * F.col("weight_left")
    rows = rows.withColumn("full", over)
    rows = rows.withColumns({
        "left": F.col("twice") - 2 * F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything),
        "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)})
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("left") * F.col("weight")).cast("double") / (2 * F.col("open")).cast("double"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series, shifted by eight where it would be inexact."""
    z = n + F.lit(9.0)
    series = (z - 0.5) * F.log(z) - z + _LOG_2PI_HALF + 1 / (12 * z) - 1 / (360 * z * z * z)
    shift = F.log((n + 1.0) * (n + 2.0) * (n + 3.0) * (n + 4.0)) + F.log((n + 5.0) * (n + 6.0) * (n + 7.0) * (n + 8.0))
    return series - shift


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambda functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(k: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of ``k`` marked among ``total`` are in a sample of ``drawn``: the ``u`` quantile.

    The masses are taken relative to the mode, over all values within twelve standard
    deviations of it; those outside have no mass that a double can tell from 0.
    """
    k, total, drawn = (c.cast("double") for c in (k, total, drawn))
    low, high = F.greatest(F.lit(0.0), drawn + k - total), F.least(k, drawn)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * (k + 1) / (total + 2)).cast("double")))
    share = k / F.greatest(total, F.lit(1.0))
    spread = F.ceil(12 * F.sqrt(drawn * share * (1 - share)) + 12)
    range_ = F.struct(k.alias("k"), total.alias("total"), drawn.alias("drawn"), u.alias("u"), mode.alias("mode"),
                      F.greatest(low, mode - spread).cast("long").alias("first"), F.least(high, mode + spread).cast("long").alias("last"))

    def quantile(r: Column) -> Column:
        def log_mass(x: Column) -> Column:
            return -_log_factorial(x) - _log_factorial(r["k"] - x) - _log_factorial(r["drawn"] - x) - _log_factorial(
                r["total"] - r["k"] - r["drawn"] + x)

        def count(ms: Column) -> Column:
            goal = r["u"] * F.aggregate(ms, F.lit(0.0), lambda s, m: s + m)
            state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"), goal.alias("goal"))
            end = F.aggregate(ms, state, lambda s, m: F.struct(
                (s["sum"] + m).alias("sum"), (s["below"] + F.when(s["sum"] + m < s["goal"], 1).otherwise(0)).alias("below"), s["goal"].alias("goal")))
            return F.least(r["last"], r["first"] + end["below"])

        return _let(log_mass(r["mode"]), lambda peak: _let(
            F.transform(F.sequence(r["first"], r["last"]), lambda x: F.exp(log_mass(x.cast("double")) - peak)), count))

    return _let(range_, quantile)


def _uniform(*of: Column) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, source, blocks) from (source, blocks): the splitting tree.

    A node is a row with an array over the sources.  Its left child gets a share of all
    its blocks in proportion to the child's number of shards, rounded down.
    """
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("source", "blocks"))).alias("own")).select(
        F.lit(0).alias("shard"), F.lit(shards).alias("width"), "own")
    state = "struct<own: array<struct<source: string, blocks: bigint>>, left: bigint, rest: bigint>"
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        total = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        half = F.expr("width div 2")
        tree = tree.withColumn("total", total)
        begin = F.struct(F.array().cast("array<struct<source: string, blocks: bigint>>").alias("own"),
                         F.expr("total * (width div 2) div width").alias("left"), F.col("total").alias("rest")).cast(state)

        def draw(s: Column, x: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("shard"), F.col("width"), F.coalesce(x["source"], F.lit("")), x["source"].isNull())
            return _let(hypergeometric(x["blocks"], s["rest"], s["left"], u), lambda got: F.struct(
                F.concat(s["own"], F.array(F.struct(x["source"].alias("source"), got.alias("blocks")))).alias("own"),
                (s["left"] - got).alias("left"), (s["rest"] - x["blocks"]).alias("rest")).cast(state))

        tree = tree.withColumn("drawn", F.when(F.col("width") > 1, F.aggregate("own", begin, draw)["own"]))
        right = F.zip_with("own", "drawn", lambda a, b: F.struct(a["source"].alias("source"), (a["blocks"] - b["blocks"]).alias("blocks")))
        children = F.when(F.col("width") > 1, F.array(
            F.struct(F.col("shard"), half.alias("width"), F.col("drawn").alias("own")),
            F.struct((F.col("shard") + half).alias("shard"), (F.col("width") - half).alias("width"), right.alias("own")))).otherwise(
            F.array(F.struct(F.col("shard"), F.col("width"), F.col("own"))))
        tree = tree.select(F.explode(children).alias("c")).select("c.*")
    return tree.select("shard", F.explode("own").alias("x")).select("shard", "x.source", "x.blocks")


@dataclass
class Plan:
    """What the mix takes, without any text.

    * ``groups``: (doc_id, source, key, size, copies, bid, before): equal rows together; ``before`` are
      the words of the block before them, known in blocks that are cut only
    * ``blocks``: (bid, source, block, words, goal0, goal1, first_shard, second_shard, is_cut, source_size, target);
      a goal is what the pass takes of the block, not yet limited to the block's words
    * ``sources``: (source, source_size, target, n_blocks)
    """

    groups: DataFrame
    blocks: DataFrame
    sources: DataFrame
    shards: int
    seed: int


def _order(doc_id: Column, text: Column) -> Column:
    """Hash that orders a source's documents; those without an id are spread by their text."""
    return F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")))


def _block(order: Column, n_blocks: Column) -> Column:
    """The first 32 bits of the hash choose the block, so blocks follow each other in hash order."""
    return F.shiftright(n_blocks * F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), 32)


def planned(documents: DataFrame, shards: int | None = None, seed: int = 0, block_words: int = BLOCK_WORDS) -> Plan:
    """Sizes in one scan of the texts; all else works on sizes and on blocks."""
    shards = shards or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("key"),
                            size.alias("size"), _order(F.col("doc_id"), F.col("text")).alias("order"))
    groups = cut(rows.groupBy("doc_id", "source", "key").agg(F.max("size").alias("size"), F.max("order").alias("order"), F.count("*").alias("copies")), "sizes")
    groups = groups.withColumn("total", F.col("size") * F.col("copies"))
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    sources = cut(targets(groups.groupBy("source").agg(F.sum("total").alias("source_size"))).withColumn("n_blocks", n), "targets")
    placed = groups.alias("g").join(sources.alias("s"), F.expr("g.source <=> s.source")).select("g.*", "source_size", "target", _block(F.col("order"), F.col("n_blocks")).alias("block"))
    blocks = placed.groupBy("source", "block").agg(F.sum("total").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    start = F.sum("words").over(Window.partitionBy("source").orderBy("block")) - F.col("words")
    goal = F.floor("target") - start
    blocks = cut(blocks.withColumns({"bid": F.monotonically_increasing_id(), "goal0": goal, "goal1": goal - F.col("source_size")}), "blocks")
    # blocks that a pass reaches; slot numbers go on through the second pass
    passes = blocks.select("source", "block", "bid", "words", F.posexplode(F.array("goal0", "goal1")).alias("pass", "goal")).filter("words > 0 and goal > 0")
    slots = passes.withColumn("slot", F.row_number().over(Window.partitionBy("source").orderBy("pass", "block")) - 1)
    shares = split_quotas(slots.groupBy("source").agg(F.count("*").alias("blocks")), shards, seed).filter("blocks > 0")
    shares = shares.withColumn("end", F.sum("blocks").over(Window.partitionBy("source").orderBy("shard")))
    dealt = slots.alias("b").join(shares.alias("q"), F.expr("b.source <=> q.source and slot >= q.end - q.blocks and slot < q.end")).groupBy("bid").agg(
        F.max(F.when(F.col("pass") == 0, F.col("shard"))).alias("first_shard"), F.max(F.when(F.col("pass") == 1, F.col("shard"))).alias("second_shard"))
    is_cut = F.expr("(goal0 > 0 and goal0 < words) or (goal1 > 0 and goal1 < words)")
    blocks = cut(blocks.join(dealt, "bid", "left").withColumn("is_cut", is_cut), "blocks")
    # running totals matter where a target ends inside a block
    known = placed.alias("p").join(blocks.alias("b"), F.expr("p.source <=> b.source and p.block = b.block")).select(
        "doc_id", "p.source", "key", "size", "order", "copies", "total", "bid", "is_cut")
    inside = sums_before(cut(known.filter("is_cut"), "cut-blocks"), ["bid"], [F.col(c).asc() for c in ("order", "doc_id", "size", "source", "key")], ["total"])
    names = ["doc_id", "source", "key", "size", "copies", "bid"]
    whole = known.filter(~F.col("is_cut")).select(*names, F.lit(None).cast("long").alias("before"))
    return Plan(cut(whole.unionByName(inside.select(*names, F.col("total_before").alias("before"))), "groups"), blocks, sources, shards, seed)


def _parts(no: Column) -> list[Column]:
    """Words that each pass takes of the ``no``-th of equal rows."""
    return [F.when(F.col(goal) >= F.col("words"), F.col("size")).when(F.col(goal) <= 0, 0).otherwise(
        F.greatest(F.lit(0), F.least(F.col("size"), F.col(goal) - F.col("before") - (no - 1) * F.col("size")))).cast("long") for goal in ("goal0", "goal1")]


def _rows(plan: Plan) -> DataFrame:
    """A row for every document with its parts; ``no`` numbers equal rows, from 1."""
    rows = plan.groups.join(plan.blocks.drop("source", "block"), "bid").withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    first, second = _parts(F.col("no"))
    return rows.withColumns({"first_part": first, "second_part": second})


def mixed_documents(documents: DataFrame, shards: int | None = None, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, first_part, second_part, first_shard, second_shard, key, no.

    ``taken`` counts repeats; the parts are the words of the two passes.  The shards are those that read the document's block in
    the first and in the second pass over its source, null where the pass ends before.
    Other columns are ignored.
    """
    return _rows(planned(documents, shards, seed, block_words)).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("first_part") + F.col("second_part")).alias("taken"), "first_part", "second_part",
        "first_shard", "second_shard", "key", "no")


def mixture(documents: DataFrame, shards: int | None = None, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of the mix, all columns of ``documents``, by output shard and shuffled inside it.

    A document taken twice is two rows.  The one at the cut keeps its first words only,
    and its n_chars, if there is such a column, is counted anew.
    """
    drawn = _drawn(documents, planned(documents, shards, seed, block_words))
    return drawn.select(*[f"c{k}" for k in range(len(documents.columns))]).toDF(*documents.columns)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows``, materialised with their writing task as _pid, with the number _no of a row among equal ones.

    Equal rows are numbered in each task's part, then over the parts, so none of them meet in one task.
    """
    keys = ["_id", "_source", "_key"]
    at = F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy(F.lit(0)))
    counts = rows.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_earlier", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_pid")) - F.col("_n"))
    return rows.withColumn("_at", at).alias("r").join(before.alias("b"), F.expr("r._id <=> b._id and r._source <=> b._source and r._key = b._key and r._pid = b._pid")).select(
        "r.*", (F.col("_at") + F.col("_earlier")).alias("_no")).drop("_at")


def _drawn(documents: DataFrame, plan: Plan) -> DataFrame:
    """The rows of the mix: columns c0, c1, ... as those of ``documents``, the key of the row they come from (_id, _source, _key, _no) and _shard.

    The block of a row follows from its id, so texts meet the blocks' table only, and are shuffled
    once, to their shards.  Rows of blocks that are taken whole have _no 0.
    """
    names = [f"c{k}" for k in range(len(documents.columns))]
    name = dict(zip(documents.columns, names))
    text = name["text"]
    rows = documents.toDF(*names).withColumns({"_id": F.col(name["doc_id"]).cast("long"), "_source": F.col(name["source"]).cast("string"), "_key": F.xxhash64(text)})
    of_source = plan.sources.select(F.col("source").alias("_s"), "n_blocks")
    rows = rows.join(of_source, F.expr("_source <=> _s")).withColumn("_block", _block(_order(F.col(name["doc_id"]), F.col(text)), F.col("n_blocks"))).drop("_s", "n_blocks")
    of_block = plan.blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "bid", "words", "goal0", "goal1", "first_shard", "second_shard", "is_cut")
    rows = rows.join(of_block, F.expr("_source <=> _s and _block = _b")).drop("_s", "_b", "_block")
    nothing = F.lit(None).cast("long")
    has_words = F.coalesce(F.regexp_like(F.col(text), F.lit(WORD)), F.lit(False)).cast("long")
    whole = rows.filter("not is_cut").withColumns({"_no": F.lit(0).cast("long"), "size": has_words, "before": nothing})
    split = _numbered(cut(rows.filter("is_cut").withColumn("_pid", F.spark_partition_id()), "cut-documents")).drop("_pid")
    sizes = plan.groups.filter("before is not null").select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("key").alias("_k"), "size", "before")
    split = split.join(sizes, F.expr("_id <=> _i and _source <=> _s and _key = _k")).drop("_i", "_s", "_k")
    first, second = _parts(F.col("_no"))
    passes = F.filter(F.array(F.struct(first.alias("words"), F.col("first_shard").alias("shard"), F.lit(0).alias("no")),
                              F.struct(second.alias("words"), F.col("second_shard").alias("shard"), F.lit(1).alias("no"))), lambda p: p["words"] > 0)
    drawn = whole.unionByName(split).withColumn("_p", F.explode(passes)).withColumns({
        "_shard": F.col("_p.shard").cast("int"), "_place": F.xxhash64(F.lit(plan.seed), "_id", "_key", "_no", F.col("_p.no"))})
    # pieces are words with the white space behind them; white space in front of the first is a piece too
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.regexp_like(F.col(text), F.lit(r"^[\x20\x09-\x0D]")).cast("int")
    short = F.rtrim(F.array_join(F.slice(pieces, F.lit(1), (F.col("_p.words") + lead).cast("int")), ""))
    drawn = drawn.withColumn("_short", F.when(F.col("_p.words") < F.col("size"), short))
    if "n_chars" in name:
        drawn = drawn.withColumn(name["n_chars"], F.when(F.col("_short").isNotNull(), F.char_length("_short").cast(
            documents.schema["n_chars"].dataType)).otherwise(F.col(name["n_chars"])))
    drawn = drawn.withColumn(text, F.coalesce("_short", text)).select(*names, "_id", "_source", "_key", "_no", "_shard", "_place")
    return drawn.repartitionById(plan.shards, "_shard").sortWithinPartitions("_shard", "_place").drop("_place")


def counted(documents: DataFrame, shards: int | None = None, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document as in ``mixed_documents``, with ``taken`` counted in the written mix.

    Of equal rows in a block that is taken whole each has its part of what the mix holds of them.
    """
    plan = planned(documents, shards, seed, block_words)
    mix = cut(_drawn(documents, plan), "mix", "zstd")
    size = F.regexp_count(f"c{documents.columns.index('text')}", F.lit(WORD))
    sums = mix.groupBy("_id", "_source", "_key", "_no").agg(F.sum(size).cast("long").alias("in_mix"))
    rows = _rows(plan).withColumn("place", F.when(F.col("is_cut"), F.col("no")).otherwise(0))
    joined = rows.join(sums, F.expr("doc_id <=> _id and source <=> _source and key = _key and place = _no"), "left")
    taken = F.coalesce(F.when(F.col("is_cut"), F.col("in_mix")).otherwise(F.expr("in_mix div copies")), F.lit(0).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "first_part", "second_part", "first_shard", "second_shard", "key", "no")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3 * sum(source_size) OVER () AS twice FROM s),
o AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
      FROM w WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (twice - 2 * capped) * weight >= 4 * source_size * weight_left AS full_up FROM o),
t AS (SELECT source, source_size, CASE WHEN full_up THEN (2 * source_size)::DOUBLE ELSE
        ((twice - 2 * sum(CASE WHEN full_up THEN 2 * source_size ELSE 0 END) OVER ()) * weight)::DOUBLE
        / (2 * sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM f),
p AS (SELECT doc_id, size, source_size, target,
        (sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, text, '')), doc_id, size ROWS UNBOUNDED PRECEDING) - size) AS begin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - begin)) + greatest(0, least(size, floor(target) - source_size - begin)))::BIGINT AS taken FROM p
"""
