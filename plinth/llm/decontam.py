"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item of m words is compared with windows of m words of every
text, at every start where enough of the window's places hold shingles of
items of that size: with fewer, no item can reach the wanted similarity,
whatever the order of its parts. A window's shingles, weighted by how often they occur, give a 64-bit SimHash.
Fingerprints are cut into blocks; an index holds every value within a few
flipped bits of each item's blocks, so that any fingerprint within the radius
meets its item in one block at least (pigeonhole). Pairs within the radius
are verified by the exact weighted Jaccard similarity, the sum of the lesser
over the sum of the greater multiplicities of their shingles.

Words are split at ASCII white space and lower-cased; an item of fewer than
five words is one shingle of its own length.

Defined cases: null or empty texts and items meet nothing; a null doc_id or
item_id is kept as such in the result; rows that repeat both id and text give
one result; a text shorter than an item is compared as a whole; of several
windows the most similar counts, then the first. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.sizes import bounded
from plinth.session import materialize

WHITE = " \t\n\x0b\f\r"
BREAK = r"[\x20\x09-\x0D]+"
SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 20
#: Bits of each block; with 7 blocks some block differs by RADIUS // 7 = 2 bits at most.
BLOCKS = (9, 9, 9, 9, 9, 9, 10)
FLIPS = RADIUS // len(BLOCKS)


def _words(text: Column) -> Column:
    body = F.btrim(F.lower(text), F.lit(WHITE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BREAK))


def _gram(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(words, at + k) for k in range(length)))


def items(benchmark: DataFrame) -> DataFrame:
    """(item, m, length, grams): each distinct item with words; ``item`` keeps id and text apart."""
    words = benchmark.select("item_id", F.xxhash64("text").alias("item_h"), _words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    sized = words.withColumn("m", F.size("w")).withColumn("length", F.least(F.lit(SHINGLE), F.col("m")))
    return sized.select("item_id", "item_h", "m", "length", _grams_of(F.col("w"), F.col("length")).alias("grams"))


def _grams_of(words: Column, length: Column) -> Column:
    """All shingle hashes of a word list, by ``length`` words each."""
    whole = F.lit(None).cast("array<bigint>")
    for n in range(1, SHINGLE + 1):
        whole = F.when((length == n) & (F.size(words) >= n), _all_grams(words, n)).otherwise(whole)
    return F.coalesce(whole, F.array().cast("array<bigint>"))


def _all_grams(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: _gram(words, i, n))


def seeds(docs: DataFrame, item_rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, m, length, start, lined): every item-sized window that can reach ``similarity``.

    A window of g shingles reaches an item of g' only with similarity / (1 +
    similarity) * (g + g') shared ones, so at least as many of its places hold
    a shingle of some item of that size. ``lined``: a shingle stands at the
    same place in the window and in an item.
    """
    lengths = sorted(r.length for r in item_rows.select("length").distinct().collect())
    places = item_rows.select("m", "length", F.posexplode("grams").alias("j", "gram")).groupBy("m", "length", "gram").agg(F.sort_array(F.collect_set("j")).alias("js"))
    places = bounded(materialize(places, "decon-places"))
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), _words(F.col("text")).alias("w"))
    found = None
    for n in lengths:
        rows = words.filter(F.size("w") >= n).select("doc_id", "h", "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("i"))
        rows = rows.select("doc_id", "h", F.size("w").alias("size"), "i", _gram(F.col("w"), F.col("i"), n).alias("gram"))
        part = rows.join(places.filter(F.col("length") == n), "gram").select("doc_id", "h", "m", "length", "size", "i", "js")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, h long, m int, length int, start int, lined boolean")
    spots = found.groupBy("doc_id", "h", "m", "length", "size").agg(F.sort_array(F.collect_set(F.struct("i", "js"))).alias("p"))
    mine, theirs = F.least("size", "m") - F.col("length") + 1, F.col("m") - F.col("length") + 1
    need = F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (mine + theirs) - 1e-9).cast("int"))
    spots = spots.withColumn("mine", mine).withColumn("need", need).filter(F.size("p") >= F.col("need")).withColumn("end", F.greatest(F.lit(0), F.col("size") - F.col("m")))
    # need places in a row, from the k-th on, lie within the windows from low to high
    low = lambda k: F.greatest(F.lit(0), F.get("p", k + F.col("need") - 1)["i"] - F.col("mine") + 1)
    high = lambda k: F.least(F.get("p", k)["i"], F.col("end"))
    runs = F.filter(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda k: F.struct(low(k).alias("low"), high(k).alias("high"))), lambda r: r["low"] <= r["high"])
    formed = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(r["low"], r["high"]), lambda s: F.struct(s.alias("start"), F.lit(True).alias("formed"), F.lit(False).alias("lined")))))
    line = lambda x: F.transform(x["js"], lambda j: F.struct(F.greatest(F.lit(0), F.least(x["i"] - j, F.col("end"))).alias("start"), F.lit(False).alias("formed"), F.lit(True).alias("lined")))
    each = spots.filter(F.size(runs) > 0).select("doc_id", "h", "m", "length", F.explode(F.concat(formed, F.flatten(F.transform("p", line)))).alias("x")).select("doc_id", "h", "m", "length", "x.*")
    return each.groupBy("doc_id", "h", "m", "length", "start").agg(F.max("formed").alias("formed"), F.max("lined").alias("lined")).filter("formed").drop("formed")


def windows(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, h, m, start, lined, gram, c): the shingles of each window, with their multiplicities."""
    by_text = materialize(starts.groupBy("doc_id", "h").agg(F.collect_list(F.struct("m", "length", "start", "lined")).alias("ws")), "decon-texts")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").filter("text is not null")
    side = bounded(by_text.select(F.col("doc_id").alias("id"), F.col("h").alias("hh"), "ws"))
    kept = rows.join(side, rows["doc_id"].eqNullSafe(F.col("id")) & (rows["h"] == F.col("hh"))).select("doc_id", "h", _words(F.col("text")).alias("w"), "ws")
    each = kept.select("doc_id", "h", "w", F.explode("ws").alias("x")).select("doc_id", "h", "x.*", F.slice("w", F.col("x.start") + 1, F.col("x.m")).alias("w"))
    each = each.dropDuplicates(["doc_id", "h", "m", "start"])
    grams = each.select("doc_id", "h", "m", "start", "lined", F.explode(_grams_of(F.col("w"), F.col("length"))).alias("gram"))
    return grams.groupBy("doc_id", "h", "m", "start", "lined", "gram").agg(F.count("*").cast("int").alias("c"))


def simhash(weighted: DataFrame, key: list[str]) -> DataFrame:
    """``key``, 64-bit ``fp`` and total weight ``n`` of each group of (gram, c)."""
    bit = lambda b: F.sum(F.when(F.shiftright(F.col("gram"), b).bitwiseAND(F.lit(1)) == 1, F.col("c")).otherwise(-F.col("c"))).alias(f"s{b}")
    summed = weighted.groupBy(*key).agg(F.sum("c").alias("n"), *(bit(b) for b in range(64)))
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"s{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return summed.select(*key, "n", fp.alias("fp"))


def _blocks() -> list[tuple[int, int, list[int]]]:
    """(shift, bits, masks with FLIPS bits set at most) of each block."""
    out, shift = [], 0
    for bits in BLOCKS:
        masks = [sum(1 << b for b in chosen) for k in range(FLIPS + 1) for chosen in combinations(range(bits), k)]
        out.append((shift, bits, masks))
        shift += bits
    return out


def hamming_candidates(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of equal ``m`` within ``radius``: ``left`` (lid, m, fp) by blocks against ``right`` (rid, m, fp) by all near block values."""
    value = lambda shift, bits: F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    probe = F.array(*(F.struct(F.lit(k).alias("block"), value(s, b).alias("value")) for k, (s, b, _) in enumerate(_blocks())))
    near = F.flatten(F.array(*(F.transform(F.array(*map(F.lit, masks)), _flip(k, value(s, b))) for k, (s, b, masks) in enumerate(_blocks()))))
    one = left.select("lid", "m", F.col("fp").alias("lfp"), F.explode(probe).alias("p")).select("lid", "m", "lfp", "p.block", "p.value")
    two = right.select("rid", "m", F.col("fp").alias("rfp"), F.explode(near).alias("p")).select("rid", "m", "rfp", "p.block", "p.value")
    met = one.join(two, ["m", "block", "value"])
    close = met.withColumn("distance", F.bit_count(F.col("lfp").bitwiseXOR(F.col("rfp")))).filter(F.col("distance") <= radius)
    return close.select("lid", "rid", "distance").distinct()


def _flip(block: int, value: Column):
    return lambda mask: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(mask).alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, h, start, n_words, distance, similarity): the best window of each text and item at or above ``similarity``."""
    item_rows = materialize(items(benchmark), "decon-items")
    starts = materialize(seeds(docs, item_rows, similarity), "decon-seeds")
    grams = materialize(windows(docs, starts), "decon-windows")
    item_key, window_key = ["item_id", "item_h", "m"], ["doc_id", "h", "m", "start", "lined"]
    item_grams = item_rows.select(*item_key, F.explode("grams").alias("gram")).groupBy(*item_key, "gram").agg(F.count("*").cast("int").alias("c"))
    window_fp = simhash(grams, window_key).select(F.struct(*window_key).alias("lid"), "m", "fp", F.col("n").alias("ln"))
    item_fp = simhash(item_grams, item_key).select(F.struct(*item_key).alias("rid"), "m", "fp", F.col("n").alias("rn"))
    window_fp, item_fp = materialize(window_fp, "decon-fp"), materialize(item_fp, "decon-item-fp")
    close = hamming_candidates(window_fp, item_fp, radius)
    pairs = close.join(window_fp.select("lid", "ln"), "lid").join(item_fp.select("rid", "rn"), "rid")
    mine = grams.select(F.struct(*window_key).alias("lid"), "gram", F.col("c").alias("c1"))
    theirs = item_grams.select(F.struct(*item_key).alias("rid"), "gram", F.col("c").alias("c2"))
    both = pairs.join(mine, "lid").join(theirs, ["rid", "gram"])
    scored = both.groupBy("lid", "rid").agg(F.sum(F.least("c1", "c2")).alias("inter"), F.first("ln").alias("ln"), F.first("rn").alias("rn"), F.first("distance").alias("distance"))
    scored = scored.withColumn("similarity", F.col("inter") / (F.col("ln") + F.col("rn") - F.col("inter"))).filter(F.col("similarity") >= similarity)
    best = scored.groupBy(F.col("lid.doc_id").alias("doc_id"), F.col("lid.h").alias("h"), F.col("rid.item_id").alias("item_id")).agg(
        F.max(F.struct("similarity", F.col("lid.lined").alias("lined"), (-F.col("lid.start")).alias("late"), F.col("lid.m").alias("m"), (-F.col("distance")).alias("far"))).alias("b")
    )
    return best.select("doc_id", "item_id", "h", (-F.col("b.late")).alias("start"), F.col("b.m").alias("n_words"), (-F.col("b.far")).alias("distance"), F.round("b.similarity", 6).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns as they are."""
    bad = bounded(materialize(leaks(docs, benchmark).select("doc_id", "h").distinct(), "decon-bad"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return rows.join(bad, rows["id"].eqNullSafe(bad["doc_id"]) & (rows["hash"] == bad["h"]), "left_anti").select("row.*")
