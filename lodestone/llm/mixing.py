"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame and SQL functions only.

Each source's documents are put into a random order (by digest) and seen as one stream of words, cut into
blocks of ``BLOCK`` words. The mix is a sequence of slots. Slot n looks up the n-th golden-ratio point in the
cumulative target shares, which names its source; the slot's rank among that source's slots names the block, and
once the stream is used up the ranks begin another pass. A source's last block is trimmed where its target ends;
where the points fall short of the last blocks (by a few, since their discrepancy is low), these follow at the end.

Ranks and word positions are two-level prefix sums: over fine buckets first (a small table), then within each bucket, so
a source that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import keyed, small, stored

BLOCK = 1000
GOLDEN = 0.6180339887498949
CHUNK = 65_536
REACH = 64
MAX_REPEAT = 3
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def place_of(doc_id: Column, source: Column, text: Column) -> Column:
    """A digest of the row: its place in a random order that any engine can compute."""
    absent = F.lit("null")
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), absent), F.coalesce(source, absent), F.md5(F.coalesce(text, F.lit("")))))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, place): the words of each text (null: 0) and its place in its source's random order."""
    rows = keyed(docs, doc_id=id_col, text=text_col, source=source_col)
    place = place_of(F.col("doc_id"), F.col("source"), F.col("text"))
    return rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place.alias("place"))


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: its size, weight and target.

    Targets share the total size by weight. A target above ``MAX_REPEAT`` times its source's size stops there and
    the excess is shared again: in the order of cap over weight, a source is capped exactly if its cap is at most its share
    of what the sources before it have left. The table has a row per source, so its windows are small.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").isNull(), "source")
    sources = sources.withColumn("place_no", F.row_number().over(by_name))
    pick = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place_no") - 1) % len(WEIGHTS) + 1)
    sources = sources.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEAT).withColumn("total", F.sum("source_size").over(everything))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place_no")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("total") - before) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    water = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * water)
    sources = sources.withColumn("target", target)
    # Whole words, blocks of a pass, and slots: as many as it takes to reach the target.
    words = F.least("cap", F.round("target").cast("long"))
    sources = sources.withColumn("words", words).withColumn("n_blocks", F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}"))
    rest = F.expr(f"(words % source_size + {BLOCK - 1}) div {BLOCK}")
    slots = F.when(F.col("source_size") > 0, F.expr("words div source_size") * F.col("n_blocks") + rest).otherwise(F.lit(0))
    sources = sources.withColumn("slots", slots.cast("long"))
    return sources.withColumn("up_to", F.sum("slots").over(Window.orderBy("place_no"))).select("source", "place_no", "source_size", "weight", "target", "words", "n_blocks", "slots", "up_to")


def schedule(sources: DataFrame) -> DataFrame:
    """(place_no, rank, slot): the slots in the order of the mix, each with its rank among its source's slots.

    The points are made on the executors. A point's owner is the source whose stretch of the cumulative shares holds it: stretches are cut
    at every ``REACH`` shares, so points and sources meet by an equal-sized piece, and a piece has few of both however many sources there are.
    """
    points = sources.agg(F.coalesce(F.max("up_to"), F.lit(0))).first()[0]
    slots = sources.sparkSession.range(0, points, 1, max(1, -(-points // CHUNK))).withColumnRenamed("id", "slot")
    slots = slots.withColumn("at", ((F.col("slot") + 0.5) * GOLDEN) % 1.0 * F.lit(points)).withColumn("piece", F.floor(F.col("at") / REACH).cast("long"))
    stretches = sources.where("slots > 0").select("place_no", (F.col("up_to") - F.col("slots")).alias("from"), "up_to")
    stretches = stretches.select("place_no", "from", "up_to", F.explode(F.expr(f"sequence(from div {REACH}, (up_to - 1) div {REACH})")).alias("piece"))
    met = slots.join(stretches.hint("merge"), "piece").where("at >= from AND at < up_to")
    drawn = met.select(F.expr(f"slot div {CHUNK}").alias("chunk"), "slot", "place_no")
    tally = drawn.groupBy("place_no", "chunk").agg(F.count("*").alias("n"))
    before = tally.withColumn("before", F.sum("n").over(Window.partitionBy("place_no").orderBy("chunk")) - F.col("n")).select("place_no", "chunk", "before")
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("place_no", "chunk").orderBy("slot")) - 1).join(before.hint("merge"), ["place_no", "chunk"])
    ranked = ranked.select("place_no", (F.col("before") + F.col("k")).alias("rank"), "slot")
    given = tally.groupBy("place_no").agg(F.sum("n").alias("given"))
    short = sources.join(given, "place_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
    tail = short.select("place_no", F.explode(F.expr("sequence(given, slots - 1)")).alias("rank"), F.expr("up_to + 0L").alias("points"))
    tail = tail.select("place_no", "rank", F.lit(None).cast("long").alias("slot"))
    wanted = sources.select("place_no", "slots", "n_blocks", "source_size", "words")
    both = ranked.unionByName(tail).join(small(wanted), "place_no").where("rank < slots")
    lo = F.expr(f"(rank % n_blocks) * {BLOCK}")
    gone = F.expr("rank div n_blocks") * F.col("source_size") + lo
    hi = F.least(lo + BLOCK, "source_size", lo + F.col("words") - gone)
    return both.select("place_no", "slot", F.expr("rank div n_blocks").alias("turn"), F.expr("rank % n_blocks").alias("block"), lo.alias("lo"), hi.alias("hi"))


def positioned(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with place_no and their first word's position ``start`` in the source's stream."""
    own = rows.withColumn("bucket", F.substring("place", 1, 3))
    names = sources.select(F.col("source").alias("of"), "place_no", "source_size", "target")
    named = own.join(small(names), own["source"].eqNullSafe(names["of"])).drop("of")
    sums = named.groupBy("place_no", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("offset", F.sum("n").over(Window.partitionBy("place_no").orderBy("bucket")) - F.col("n")).select("place_no", "bucket", "offset")
    within = Window.partitionBy("place_no", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ran = named.withColumn("ran", F.sum("size").over(within)).withColumn("row_no", F.count("*").over(within)).join(sums.hint("merge"), ["place_no", "bucket"])
    return ran.withColumn("start", F.col("offset") + F.col("ran") - F.col("size")).drop("offset", "ran")


def takes(rows: DataFrame, sources: DataFrame, slots: DataFrame) -> DataFrame:
    """Each row of ``positioned`` for each turn (pass) that takes any of its words, with ``words`` and the first ``slot`` that does; else once with turn null."""
    blocks = F.when(F.col("size") > 0, F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})"))
    pieces = positioned(rows, sources).withColumn("block", F.explode_outer(blocks))
    uses = slots.select("place_no", "block", "turn", "lo", "hi", "slot").hint("merge")  # it grows with the table: never broadcast
    met = pieces.join(uses, ["place_no", "block"], "left")
    shared = F.greatest(F.lit(0), F.least("hi", F.col("start") + F.col("size")) - F.greatest("lo", "start"))
    met = met.withColumn("words", F.coalesce(F.when(F.col("hi").isNotNull(), shared), F.lit(0)))
    return met.groupBy("doc_id", "source", "size", "place", "source_size", "target", "place_no", "bucket", "row_no", "turn").agg(F.sum("words").alias("words"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("slot"))


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = stored(sized(docs, id_col, text_col, source_col), "mix-rows")
    sources = stored(targets(rows), "mix-sources")
    return rows, sources, schedule(sources)


def mixed_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and ``taken``, the words that the mix takes.

    A null text has size 0; the null source is a source of its own and the last one. Repeated rows stand side by side in
    the stream, each with its own share. A source without words has target 0. Reruns agree, whatever the partitions.
    """
    found = takes(*planned(docs, id_col, text_col, source_col))
    return found.groupBy("doc_id", "source", "size", "source_size", "target", "place", "place_no", "bucket", "row_no").agg(F.sum("words").alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each turn that takes a document, in the order of the first slot that does.

    A document taken whole keeps its text; one that a turn takes in part (at most one per source, the last) keeps its first
    words, joined by single spaces. Rows equal in id, source and text are one document here, which takes what is due to all of them. Null and empty
    texts have no words and don't come; an empty table stays empty; extra columns may have any name.
    """
    found = takes(*planned(docs, id_col, text_col, source_col)).where("words > 0").select("place", F.col("size").alias("whole"), F.col("words").alias("take"), "slot")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(names[text_col])
    numbered = docs.select(place_of(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.col(f"`{text_col}`")).alias("place"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    met = numbered.dropDuplicates(["place"]).join(found, "place")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), 1, F.col("take").cast("int")), " ")
    met = met.withColumn(names[text_col], F.when(F.col("take") == F.col("whole"), text).otherwise(cut))
    met = met.orderBy(F.col("slot").asc_nulls_last(), "place", F.col("take").desc())
    return met.select(*[F.col(n).alias(c) for c, n in names.items()])
