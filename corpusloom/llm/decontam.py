"""Benchmark decontamination by winnowing.

An item window is ``span`` consecutive words (10); an item with fewer words, but not
none, is one window.  Words are hashed, ``gram`` (6) neighbours give one hash, and of
every ``span - gram + 1`` (5) neighbouring hashes only the smallest is a fingerprint.
A shared run of ``span`` words holds 5 whole grams, whose smallest both sides keep:
no shared window can be missed.  Fingerprints of texts are joined with those of the
items; a hit fixes an alignment of text and item, along which equal words are
extended to the longest runs; runs of a whole window count, so hash collisions and
shorter overlaps leave no trace.  Items shorter than a window use grams of their own
length, all of them fingerprints; one pass over the texts makes those of every length.

Both sides are winnowed whatever their size.  A counted size decides only how a join is
carried out: the smaller side is broadcast, or each key is dealt to several tasks.
All functions here run jobs when they are called, as lineage is cut between the steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD_RUN, NON_WORD_RUN_ANY_CASE, ascii_lower, cut, fresh, join_sized, let, split_words

SPAN = 10
GRAM = 6
#: A join's smaller side is broadcast up to this many rows (and common.BROADCAST_BYTES).
BROADCAST_ROWS = 500_000


def item_words(c: Column) -> Column:
    return split_words(ascii_lower(c), NON_WORD_RUN)


def hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """Add the hash of every word: the array ``codes`` beside ``words``."""
    return docs.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))


def _rolled(codes: Column, gram: int) -> Column:
    """For every word the hash of ``gram`` words from it on; the last ones, of too few words, mean nothing."""
    def joined(a: Column, b: Column, shift: int) -> Column:
        return F.zip_with(a, F.slice(b, shift + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))

    if gram == 1:
        return codes
    if gram % 2:
        return joined(_rolled(codes, gram - 1), codes, gram - 1)
    return let(_rolled(codes, gram // 2), lambda half: joined(half, half, gram // 2))


def _grams(gram: int) -> Column:
    """The hashes of all grams of a text, in order."""
    return F.slice(_rolled(F.col("codes"), gram), F.lit(1), F.greatest(F.size("codes") - gram + 1, F.lit(0)))


def _plan(size: int) -> tuple[int, int]:
    """(gram, window): how items with windows of ``size`` words are winnowed; shorter ones keep all their grams."""
    return (GRAM, SPAN - GRAM + 1) if size == SPAN else (size, 1)


def _is_smallest(grams: str, w: Column, window: int) -> Column:
    """Whether the gram at ``w`` has the smallest hash of some window of ``window`` grams that holds it."""
    own, last = F.get(grams, w), F.size(grams) - 1
    out = F.lit(False)
    for before in range(window):
        after = window - 1 - before
        others = [F.get(grams, w + i) for i in range(-before, after + 1) if i]
        out = out | ((w >= before) & (w + after <= last) & (own <= F.least(*others)))
    return out


def winnow(docs: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """``docs(words, codes, *keep)`` -> its fingerprints: ``*keep, size, at, h``, for item windows of each size.

    h is the hash of the gram at place ``at``, the smallest of a window of neighbouring
    grams; equal smallest ones of a window are all kept.
    """
    rows = docs.select(*keep, F.size("codes").alias("n"), *[_grams(_plan(n)[0]).alias(f"grams{n}") for n in sizes])
    at = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))
    rows = rows.select(*keep, *[f"grams{n}" for n in sizes], F.explode(at).alias("at"))

    def kept(size: int) -> Column:
        grams, window = f"grams{size}", _plan(size)[1]
        return _is_smallest(grams, F.col("at"), window) if window > 1 else F.col("at") < F.size(grams)

    if len(sizes) == 1:
        return rows.where(kept(sizes[0])).select(*keep, F.lit(sizes[0]).alias("size"), "at", F.get(f"grams{sizes[0]}", "at").alias("h"))
    found = [F.when(kept(n), F.struct(F.lit(n).alias("size"), F.col("at").alias("at"), F.get(f"grams{n}", "at").alias("h"))) for n in sizes]
    return rows.select(*keep, F.explode(F.array(*found)).alias("x")).where("x is not null").select(*keep, "x.*")


def _alignments(docs: DataFrame, items: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """``keys, item, length, shift``: the item's words lie at text words ``shift``.., by a shared fingerprint.

    The item side lists every place of each fingerprint's hash, so it doesn't matter
    which of several equal grams of a window a text is aligned by.
    """
    own = F.least(F.size("words"), F.lit(SPAN))
    none = F.array().cast("array<struct<place:int,h:bigint>>")
    grams = none
    for n in sizes:
        grams = F.when(own == n, F.transform(_grams(_plan(n)[0]), lambda h, i: F.struct(i.alias("place"), h.alias("h")))).otherwise(grams)
    wanted = winnow(items.withColumn("own", own), sizes, "item", "own").where("size = own").select("item", "h").distinct()
    places = items.select("item", F.size("words").alias("length"), own.alias("size"), F.explode(grams).alias("x")).select("item", "length", "size", "x.*")
    prints = cut(places.join(wanted, ["item", "h"]).distinct())
    hits = join_sized(winnow(docs, sizes, *keys), prints, ["size", "h"], BROADCAST_ROWS)
    return cut(hits.select(*keys, "item", "length", (F.col("at") - F.col("place")).alias("shift")).distinct())


def _runs(aligned: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, item, lo, hi``: runs of equal words, in text positions, that hold a whole window."""
    lead = F.greatest(-F.col("shift"), F.lit(0))
    other = F.slice("words", lead + 1, F.size("part"))
    same = F.zip_with("part", other, lambda a, b: a == b)
    df = join_sized(aligned, items.select("item", "words"), ["item"], BROADCAST_ROWS).select(
        *keys, "item", F.greatest(F.col("shift"), F.lit(0)).alias("first"),
        F.least(F.size("words"), F.lit(SPAN)).alias("need"),
        # Places where the words differ, with one before and one after all.
        F.concat(F.array(F.lit(-1)), F.filter(F.transform(same, lambda x, i: F.when(~x, i)), lambda x: x.isNotNull()), F.array(F.size("part"))).alias("breaks"),
    )
    runs = df.select(*keys, "item", "first", "need", F.posexplode("breaks").alias("k", "to"), "breaks")
    runs = runs.where("k > 0").withColumn("from", F.get("breaks", F.col("k") - 1) + 1)
    return runs.where("to - from >= need").select(*keys, "item", (F.col("first") + F.col("from")).alias("lo"), (F.col("first") + F.col("to")).alias("hi"))


def item_runs(docs: DataFrame, items: DataFrame, keys: list[str], text: str) -> DataFrame:
    """All whole-window overlaps of ``docs(keys, text)`` with ``items(item, words)``: ``keys, item, lo, hi``."""
    items = cut(hashed(items.where(F.size("words") > 0), "item"))
    # At most SPAN numbers; SPAN itself is always among them.
    sizes = sorted({SPAN, *(r[0] for r in items.select(F.least(F.size("words"), F.lit(SPAN))).distinct().collect())})
    words = item_words(F.col(text)).alias("words")
    hits = _alignments(hashed(docs.select(*keys, words), *keys), items, keys, sizes)
    # Only texts with a hit are split into words again, each once for all its hits.
    worth = join_sized(docs.select(*keys, text), hits.select(*keys).distinct(), keys, BROADCAST_ROWS, "left_semi")
    found = join_sized(worth.select(*keys, words), hits, keys, BROADCAST_ROWS)
    first = F.greatest(F.col("shift"), F.lit(0))
    part = F.slice("words", first + 1, F.col("shift") + F.col("length") - first)
    return _runs(found.select(*keys, "item", "shift", part.alias("part")), items, keys)


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """``item, words`` of every item with an id; an id listed twice is two items with one id."""
    return benchmark.where(F.col(item).isNotNull()).select(
        F.struct(F.col(item).cast("string").alias("id"), F.xxhash64(text).alias("of")).alias("item"), item_words(F.col(text)).alias("words")
    ).dropDuplicates(["item"])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    NULL and empty texts have no words and no hits; rows that repeat a key are told
    apart by their texts, equal rows each get a row; items with a NULL id or text, or
    without words, are left out; an id listed twice is one item with both texts' windows.
    """
    named = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    runs = cut(item_runs(named, _items(benchmark, item, item_text), ["key", "text_key"], "text"))
    spans = runs.groupBy("key", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"),
        F.sort_array(F.collect_set("item.id")).alias("ids"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["hi"]).alias("end"),
            (acc["n"] + F.greatest(x["hi"] - F.greatest(acc["end"], x["lo"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    hit = spans.select(
        "key", "text_key", covered.cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
    )
    sizes = docs.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("text_key"),
        F.size(split_words(F.col(text), NON_WORD_RUN_ANY_CASE)).cast("long").alias("n_words"),
    )
    return join_sized(sizes, cut(hit), ["key", "text_key"], BROADCAST_ROWS, "left").select(
        F.col("key").alias(key), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
                      item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any whole item window, all columns kept, whatever their names.

    NULL and empty texts have no words and stay, as do all rows where ``benchmark`` is
    empty; of rows that repeat a key only those whose own text has a window go.
    """
    k, t = fresh(docs, "_doc_key"), fresh(docs, "_doc_text_key")
    keyed = docs.withColumns({k: F.col(key), t: F.xxhash64(text)})
    named = keyed.select(k, t, F.col(text).alias("text"))
    bad = cut(item_runs(named, _items(benchmark, item, item_text), [k, t], "text").select(k, t).distinct())
    return join_sized(keyed, bad, [k, t], BROADCAST_ROWS, "left_anti").select(*docs.columns)
