"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are compared once per distinct value.  The 64 bits are cut into
``blocks`` blocks; two fingerprints within ``distance`` bits agree on at least
``blocks - distance`` whole blocks, so for every choice of that many blocks there
is one table whose upper nodes are the shared masked bit patterns.  Below an upper
node the other bits are put in Gray order (consecutive ranks differ in one bit)
and cut by rank prefix into at most 256 groups; each group keeps the AND and the OR of
its members, i.e. the bits on which all agree.  A pair of groups under one node is
dropped when the agreed bits alone differ in more than ``distance`` places, is
linked as a whole when no two members can differ in more, and only else are
members compared, each of one group until it meets one of the other.  Nothing is dropped that could hold a link.

Links between members are never listed.  Each member is first linked to a few others,
by its node, its group and its place in Gray order, and the classes that this makes are
looked up.  Only members of different classes that share a node are then compared, and
what comes out is which classes are linked.  A node where many such members meet, as those of a
template's pages do, is split first by patterns of the bits that it leaves free.

All functions but fingerprints() run jobs when they are called.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, ascii_lower, cut, fresh, join_sized, split_words
from .components import components

BITS = 64
LANES = 32
GROUP_BITS = 8
#: Fingerprints to an upper node, on average, from which on more blocks are taken.
NODE_SIZE = 8
MOST_BLOCKS = 10
#: A node with more members that first links don't join is split, so many times at most.
HEAVY_NODE = 256
MOST_SPLITS = 4
#: A join's smaller side is broadcast up to this many rows (and common.BROADCAST_BYTES).
BROADCAST_ROWS = 500_000
#: Fingerprints to a task.
SHARE = 20_000


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4) -> DataFrame:
    """``(key, text_key, copies, fp)``: the SimHash of every text, over ``shingle``-word shingles.

    A text with fewer words is one shingle, one without words (NULL too) gets 0.
    ``text_key`` tells apart rows that repeat a key; equal rows are one row with ``copies``.
    Two bits are counted in one 64-bit sum, 32 bits wide each, inside generated code.
    """
    words = docs.select(
        F.col(key),
        F.xxhash64(text).alias("text_key"),
        split_words(ascii_lower(F.col(text)), BLANK_RUN).alias("words"),
    )
    at = words.select(
        key, "text_key", "words",
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - shingle, F.lit(0)))).alias("at"),
    )
    hashed = at.select(
        key, "text_key", "at",
        F.when(F.size("words") == 0, F.lit(0).cast("long"))
        .otherwise(F.xxhash64(F.concat_ws(" ", *[F.get("words", F.col("at") + i) for i in range(shingle)])))
        .alias("h"),
    )
    pair = (1 << 32) | 1
    sums = hashed.groupBy(key, "text_key").agg(
        F.count("*").alias("n"),
        F.sum((F.col("at") == 0).cast("long")).alias("copies"),
        *[F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(pair))).alias(f"s{j}") for j in range(LANES)],
    )
    fp: Column = F.lit(0).cast("long")
    for j in range(LANES):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"s{j}"), 32)
        for bit, count in ((j, low), (j + 32, high)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return sums.select(key, "text_key", "copies", fp.alias("fp"))


def with_gray_rank(df: DataFrame, bits: str, out: str) -> DataFrame:
    """Add the place of the pattern ``bits`` in the reflected Gray sequence."""
    df = df.withColumn(out, F.col(bits))
    for step in (1, 2, 4, 8, 16, 32):
        df = df.withColumn(out, F.col(out).bitwiseXOR(F.shiftrightunsigned(out, step)))
    return df


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def index_tables(distance: int, blocks: int, group_bits: int, agreed: int = 0) -> list[tuple[int, int, int]]:
    """(table, mask of the bits that agree, shift that leaves ``group_bits`` free bits of the rank).

    The bits outside ``agreed``, a mask that is part of all masks, are cut into the blocks.
    """
    bits = [i for i in range(BITS - 1, -1, -1) if not agreed >> i & 1]
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    spans = [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:])]
    out = []
    for t, chosen in enumerate(combinations(spans, blocks - distance)):
        mask = agreed & ((1 << BITS) - 1) | sum(chosen)
        free = [i for i in bits if not mask >> i & 1]
        out.append((t, _signed(mask), free[min(group_bits, len(free)) - 1] if free else 0))
    return out


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose patterns spread ``n`` fingerprints thinly; more blocks mean more tables.

    With 4 bits' distance: 6 blocks (15 tables, 21 bits) to 16 million fingerprints, 7
    (35, 27) to 10^9, 8 (70, 32) to 3 * 10^10.  The result doesn't depend on it.
    """
    blocks = distance + 2
    while blocks < MOST_BLOCKS and n > NODE_SIZE << BITS * (blocks - distance) // blocks:
        blocks += 1
    return blocks


def _placed(rows: DataFrame) -> DataFrame:
    """``rows(mask, shift, fp, ...)`` with the node, the rank and the group of each row in the table of its mask."""
    rows = rows.withColumns({"node": F.col("fp").bitwiseAND(F.col("mask")), "free": F.col("fp").bitwiseAND(F.bitwise_not("mask"))})
    return with_gray_rank(rows, "free", "rank").withColumn("g", F.expr("shiftrightunsigned(rank, shift)")).drop("free", "shift")


def _undecided(classed: DataFrame) -> DataFrame:
    """The rows of nodes that hold members of different classes."""
    node = ["mask", "node"]
    live = cut(classed.groupBy(*node).agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select(*node))
    return cut(classed.join(live, node, "left_semi"))


def _split(classed: DataFrame, distance: int, group_bits: int) -> DataFrame:
    """``classed(mask, node, g, fp, class)`` with the nodes of more than HEAVY_NODE members replaced by nodes below them.

    Members of a node agree on its mask; what links them lies in the other bits, which are cut
    into blocks like the whole was, so that linked members share one of the nodes below.  That goes
    on while nodes are heavy and their masks leave bits to cut; masks are as many as there
    are tables and their parts, whatever the number of members.
    """
    node, done = ["mask", "node"], []
    blocks = distance + 2
    for _ in range(MOST_SPLITS):
        heavy = cut(classed.groupBy(*node).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY_NODE).select(*node))
        heavy = heavy.where(f"64 - bit_count(mask) >= {2 * blocks}")
        masks = [r.mask for r in heavy.select("mask").distinct().collect()]
        if not masks:
            break
        below = [(m, sub, shift) for m in masks for _, sub, shift in index_tables(distance, blocks, group_bits, m & ((1 << BITS) - 1))]
        tables = F.broadcast(classed.sparkSession.createDataFrame(below, "mask long, sub long, shift int"))
        done.append(join_sized(classed, heavy, node, BROADCAST_ROWS, "left_anti", counted=True).select(*classed.columns))
        parts = join_sized(classed, heavy, node, BROADCAST_ROWS, "left_semi", counted=True).select("mask", "fp", "class").join(tables, "mask")
        parts = _placed(parts.select(F.col("sub").alias("mask"), "shift", "fp", "class").distinct())
        classed = _undecided(parts.select(*node, "g", "fp", "class"))
    for part in done:
        classed = classed.union(part.select(*classed.columns))
    return cut(classed) if done else classed


def linked_classes(fps: DataFrame, distance: int = 4, blocks: int | None = None, group_bits: int = GROUP_BITS) -> DataFrame:
    """``fps(fp)``, distinct -> ``(node, root)``: the class of every fingerprint that has a link, named by one of its members."""
    n = fps.count()
    blocks = blocks or blocks_for(n, distance)
    # Every fingerprint makes a row for each table: the work is dealt out by their number, not by the size of the files.
    fps = fps.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, n // SHARE + 1), "fp")
    tables = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(s).alias("shift")) for _, m, s in index_tables(distance, blocks, group_bits)])
    placed = _placed(fps.select("fp", F.explode(tables).alias("i")).select("fp", "i.mask", "i.shift"))
    node, group = ["mask", "node"], ["mask", "node", "g"]
    # A node of two that aren't linked, as most are where patterns meet by chance, is done with.
    ends = placed.groupBy(*node).agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    ends = cut(ends.where(f"n > 2 or n = 2 and bit_count(low ^ high) <= {distance}").drop("n"))
    members = cut(placed.join(ends, node))
    # First links, at most four a member: the ends of its node, the least of its group, the next in Gray order.
    in_order = Window.partitionBy(*group).orderBy("rank", "fp")
    near = members.select("fp", "low", "high", F.first("fp").over(in_order).alias("least"), F.coalesce(F.lead("fp").over(in_order), "fp").alias("next"))
    near = near.select("fp", F.explode(F.array("low", "high", "least", "next")).alias("to"))
    known = components(near.where(f"fp <> to and bit_count(fp ^ to) <= {distance}").select(F.col("fp").alias("a"), F.col("to").alias("b")))
    classed = members.select(*group, "fp").join(known.withColumnRenamed("node", "fp"), "fp", "left")
    classed = cut(classed.select(*group, "fp", F.coalesce("root", "fp").alias("class")))
    classed = _split(_undecided(classed), distance, group_bits)
    # What is left to compare: members of one node in different classes, group by group and class by class.
    groups = cut(classed.groupBy(*group, "class").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any")))
    one, two = (groups.select(*node, *[F.col(c).alias(f"{c}{i}") for c in ("g", "class", "ones", "any")]) for i in (1, 2))
    pairs = cut(
        one.join(two, node).where(f"class1 < class2 and bit_count((ones1 & ~any2) | (ones2 & ~any1)) <= {distance}")
        .withColumn("whole", F.expr(f"bit_count((any1 | any2) & ~(ones1 & ones2)) <= {distance}"))
    )
    a, b = (classed.select(*node, F.col("g").alias(f"g{i}"), F.col("class").alias(f"class{i}"), F.col("fp").alias(f"fp{i}")) for i in (1, 2))
    some = pairs.where("not whole").join(a, [*node, "g1", "class1"]).alias("x")
    same = " and ".join(f"x.{c} = y.{c}" for c in (*node, "g2", "class2"))
    linked = some.join(b.alias("y"), F.expr(f"{same} and bit_count(x.fp1 ^ y.fp2) <= {distance}"), "left_semi")
    joined = pairs.where("whole").select("class1", "class2").union(linked.select("class1", "class2")).distinct()
    steps = components(joined.select(F.col("class1").alias("a"), F.col("class2").alias("b")))
    moved = join_sized(known, steps.select(F.col("node").alias("root"), F.col("root").alias("to")), ["root"], BROADCAST_ROWS, "left", counted=True)
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    single = join_sized(steps, known.select("node"), ["node"], BROADCAST_ROWS, "left_anti", counted=True).select("node", "root")
    return cut(moved.union(single))


def near_links(fps: DataFrame, distance: int = 4, blocks: int | None = None, group_bits: int = GROUP_BITS) -> DataFrame:
    """``fps(fp)``, distinct -> ``(a, b)``: each linked fingerprint and the one that names its class.

    At most a row for each fingerprint; the components are those of all pairs within ``distance`` bits.
    """
    return linked_classes(fps, distance, blocks, group_bits).where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def rooted(rows: DataFrame, key: str, distance: int, blocks: int | None) -> DataFrame:
    """``(fp, first, root)`` for every fingerprint of ``rows(key, fp)``: its smallest key and its class, named by a fingerprint."""
    firsts = cut(rows.groupBy("fp").agg(F.min(key).alias("first")))
    roots = linked_classes(firsts.select("fp"), distance, blocks).withColumnRenamed("node", "fp")
    return cut(join_sized(firsts, roots, ["fp"], BROADCAST_ROWS, "left", counted=True).select("fp", "first", F.coalesce("root", "fp").alias("root")))


def classes(rows: DataFrame, key: str, distance: int, blocks: int | None) -> DataFrame:
    """``(fp, component_id)`` for every fingerprint of ``rows(key, fp)``."""
    linked = rooted(rows, key, distance, blocks)
    smallest = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    return cut(join_sized(linked, smallest, ["root"], BROADCAST_ROWS, counted=True).select("fp", "component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4,
                    distance: int = 4, blocks: int | None = None) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest key among all rows reachable over links, the row's
    own included; NULL keys take part in linking but never are that smallest key
    (a component of NULL keys only has NULL).  Repeated rows stay repeated; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = cut(fingerprints(docs, text, key, shingle))
    return (
        join_sized(rows, classes(rows, key, distance, blocks), ["fp"], BROADCAST_ROWS, counted=True)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row of ``docs`` per smallest key of a group of near-duplicates, all columns kept.

    Groups that share that key (a repeated one, or NULL) are one here; see keep_one_per_class.
    NULL keys come after all others; of rows that repeat the smallest key one stays
    (the least by the hash of its text).  The few keys that survive or fall are joined,
    never the groups.
    """
    rows = cut(fingerprints(docs, text, key, shingle))
    of = classes(rows, key, distance, blocks)
    # Kept where the row's key is its class's smallest; NULL-only classes keep a NULL key.
    k, t = fresh(docs, "_k"), fresh(docs, "_t")
    chosen = cut(
        join_sized(rows, of, ["fp"], BROADCAST_ROWS, counted=True).where(F.col(key).eqNullSafe(F.col("component_id")))
        .groupBy("component_id").agg(F.min(F.struct("fp", "text_key")).alias("one"))
        .select(F.col("component_id").alias(k), F.col("one.text_key").alias(t))
    )
    kept = join_sized(docs.withColumns({k: F.col(key), t: F.xxhash64(text)}), chosen, [k, t], BROADCAST_ROWS, "left_semi").select(*docs.columns)
    return kept.dropDuplicates([key]) if _repeats(rows) else kept


def keep_one_per_class(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row of ``docs`` per group of near-duplicates, all columns kept, whatever keys repeat or are NULL.

    It is the row with the smallest key, NULL after all others, and of equal keys the
    least by the hash of its text.  Rows that agree in key and text are one row.  Rows
    without words (NULL, empty or blank texts) are one group.  The keys of the rows that
    go are joined, which are fewer than those that stay.
    """
    rows = cut(fingerprints(docs, text, key, shingle))
    of = rooted(rows, key, distance, blocks).select("fp", "root")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("text_key").alias("text_key"), F.col("copies").alias("copies"))
    k, t = fresh(docs, "_k"), fresh(docs, "_t")
    placed = cut(join_sized(rows, of, ["fp"], BROADCAST_ROWS, counted=True).select("root", order.alias("row")))
    chosen = cut(placed.groupBy("root").agg(F.min("row").alias("one")))
    gone = join_sized(placed, chosen, ["root"], BROADCAST_ROWS, "left", counted=True).where("row <> one")
    gone = cut(gone.select(F.col("row.key").alias(k), F.col("row.text_key").alias(t)))
    several = cut(chosen.where("one.copies > 1").select(F.col("one.key").alias(k), F.col("one.text_key").alias(t)))
    named = docs.withColumns({k: F.col(key), t: F.xxhash64(text)})
    kept = join_sized(named, gone, [k, t], BROADCAST_ROWS, "left_anti")
    if several.isEmpty():
        return kept.select(*docs.columns)
    single = join_sized(kept, several, [k, t], BROADCAST_ROWS, "left_anti")
    repeated = join_sized(kept, several, [k, t], BROADCAST_ROWS, "left_semi").dropDuplicates([k, t])
    return single.union(repeated).select(*docs.columns)


def _repeats(rows: DataFrame) -> bool:
    """Whether any row is there more than once."""
    return not rows.where("copies > 1").isEmpty()
