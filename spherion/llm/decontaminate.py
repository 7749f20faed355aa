"""Benchmark decontamination in DataFrame functions only.

A document window as long as a benchmark item counts as a leak when its multiset of five-word shingles and the item's
have a Jaccard similarity of at least 0.8.  Window fingerprints (SimHash) meet item fingerprints in eight blocks of eight
bits, where items stand under the whole ball of radius two: that finds every pair of one length within 23 bits.  What is
found is verified exactly.

Which windows get a fingerprint is a shortcut that can't lose a leak: such a window shares all but a few shingles with the
item, so it shares one at every few positions; only shingles at each ``stride``-th position are looked up, and only windows
around a hit are fingerprinted.  At a similarity of 0.8 fingerprints differ in some ten bits with a deviation of three, so
beyond 23 lies less than one leak in 10,000 (tests find every brute-force hit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.llm.shared import keep_rows

SHINGLE, SIMILARITY, BLOCKS, BLOCK_BITS, BALL = 5, 0.8, 8, 8, 2
#: All pairs within so many bits meet: beyond BALL in each of the blocks they would differ in more.
RADIUS = BLOCKS * (BALL + 1) - 1
#: What is within BALL bits of a block's value.
NEAR = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= BALL]
#: Rows of the benchmark's lookup tables up to which they are sent to every executor.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_at(words: Column, at: Column, size: int = SHINGLE) -> Column:
    """Hash of the words at - 1 to at + size - 2 (``at`` counts from one)."""
    return F.xxhash64(*[F.get(words, at + (k - 1)) for k in range(size)])


def all_shingles(words: Column) -> Column:
    last = F.size(words) - (SHINGLE - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: shingle_at(words, i)))


def simhash(hashes: Column, n: Column, lane: int) -> Column:
    """Bits set in over half of ``hashes``; counts stand side by side in lanes of ``lane`` bits."""
    mask = sum(1 << at for at in range(0, 64, lane))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(lane)])
    counts = F.aggregate(hashes, zero, lambda acc, h: F.struct(*[(acc[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(mask))).alias(f"c{k}") for k in range(lane)]))
    out = F.lit(0).cast("long")
    for k in range(lane):
        for at in range(0, 64, lane):
            count = F.shiftrightunsigned(counts[f"c{k}"], at).bitwiseAND(F.lit((1 << lane) - 1))
            out = out.bitwiseOR(F.when(count * 2 > n, F.shiftleft(F.lit(1).cast("long"), at + k)).otherwise(F.lit(0).cast("long")))
    return out


def lane_for(n: int) -> int:
    """Bits of a lane in which ``n`` can be counted."""
    return 8 if n < 1 << 8 else 16 if n < 1 << 16 else 32


def block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def numbered(hashes: Column) -> Column:
    """The multiset as a set: the second, third ... occurrence of a hash gets a value of its own."""
    seen = F.transform(hashes, lambda x, i: F.named_struct(F.lit("x"), x, F.lit("o"), F.size(F.filter(F.slice(hashes, 1, i + 1), lambda y: y == x))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(F.transform(seen, lambda s: F.when(s["o"] == 1, s["x"]).otherwise(F.xxhash64(s["x"], s["o"]))))


def widest_stride(lengths: list[int]) -> int:
    """The widest sampling at which every window that is similar enough to an item holds a shared sample.

    Of m shingles at least 2 t m / (1 + t) are shared, and m consecutive positions hold floor(m / s) samples.
    """
    lost = [m - (2 * SIMILARITY * m / (1 + SIMILARITY)) for m in lengths]
    return max(s for s in range(1, 9) if s == 1 or all(m // s > x + 1e-9 for m, x in zip(lengths, lost)))


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, word_start, n_words): each item that a document holds, at its best window.

    Words are runs of letters and digits of the lower-cased whole text.  Items of fewer than five words leak only as
    the same sequence of words; items and documents without words, with null text, or empty tables give no rows.  Null
    ids pass through; equal rows of documents give one row; the first of equally similar windows counts; other columns
    are not read.
    """
    given = items.select(F.col("item_id"), words_of(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    given = given.select("item_id", "iw", F.size("iw").alias("len"))
    facts = given.agg(F.collect_set("len").alias("lens"), F.sum("len").alias("words"), F.count("*").alias("n")).first()
    lens, sent = sorted(facts["lens"]), (facts["words"] or 0) + (facts["n"] or 0) * BLOCKS * len(NEAR) <= BROADCAST_ROWS
    small = (lambda df: F.broadcast(df)) if sent else (lambda df: df)
    texts = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    out = [_long_leaks(texts, given.where(F.col("len") >= SHINGLE), [n - SHINGLE + 1 for n in lens if n >= SHINGLE], small)]
    out += [_short_leaks(texts, given.where(F.col("len") == n), n, small) for n in lens if n < SHINGLE]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back") - 1).alias("word_start"), F.col("b.n_words").alias("n_words"))


def _short_leaks(texts: DataFrame, given: DataFrame, n: int, small) -> DataFrame:
    at = texts.where(F.size("w") >= n).select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (n - 1))).alias("start"))
    hashed = at.select("doc_id", "start", shingle_at(F.col("w"), F.col("start"), n).alias("h"))
    known = given.select("item_id", shingle_at(F.col("iw"), F.lit(1), n).alias("h"))
    return hashed.join(small(known), "h").select("doc_id", "item_id", "start", F.lit(n).alias("n_words"), F.lit(1.0).alias("similarity"))


def _long_leaks(texts: DataFrame, given: DataFrame, lengths: list[int], small) -> DataFrame:
    stride, lane = widest_stride(lengths or [1]), lane_for(max(lengths, default=1))
    item = given.select("item_id", all_shingles(F.col("iw")).alias("ih")).withColumn("m", F.size("ih"))
    known = item.select("m", F.explode("ih").alias("h")).groupBy("h").agg(F.collect_set("m").alias("ms"))
    before = known.select(F.col("h").alias("hb"), F.explode("ms").alias("mb"))

    # Samples, and those that the benchmark knows.
    last = F.size("w") - (SHINGLE - 1)
    at = texts.where(F.size("w") >= SHINGLE).select("doc_id", "w", F.explode(F.sequence(F.lit(1), last, F.lit(stride))).alias("p"))
    hit = at.withColumn("h", shingle_at(F.col("w"), F.col("p"))).join(small(known), "h")
    hit = hit.select("doc_id", "w", "p", F.explode("ms").alias("m"), F.when(F.col("p") > stride, shingle_at(F.col("w"), F.col("p") - stride)).alias("hb"))
    hit = hit.join(small(before), (hit["hb"] == before["hb"]) & (hit["m"] == before["mb"]), "left")

    # Windows of m shingles whose first known sample is this one (the sample before it has those that hold it too).
    p, m = F.col("p"), F.col("m")
    first = F.greatest(F.lit(1), F.when(F.col("mb").isNotNull(), p - (stride - 1)).otherwise(p - m + 1))
    # A text of fewer shingles, but enough for the similarity, is its own one window.
    ends = F.when(last < m, F.lit(1)).otherwise(F.least(p, last - m + 1))
    first = F.when(last < m, F.lit(1)).otherwise(first)
    hit = hit.where((last >= m) | ((last >= SIMILARITY * m) & F.col("mb").isNull())).select("doc_id", "w", "m", F.least(m, last).alias("held"), first.alias("lo"), ends.alias("hi")).where("hi >= lo")
    around = hit.select("doc_id", "m", "held", "lo", "hi", F.transform(F.sequence(F.col("lo"), F.col("hi") + F.col("held") - 1), lambda i: shingle_at(F.col("w"), i)).alias("near"))
    window = around.select("doc_id", "m", "held", "lo", "near", F.explode(F.sequence("lo", "hi")).alias("start"))
    window = window.select("doc_id", "m", "held", "start", F.slice("near", F.col("start") - F.col("lo") + 1, F.col("held")).alias("wh"))
    window = window.withColumn("fp", simhash(F.col("wh"), F.col("held"), lane))

    # Meet in blocks; a pair counts in the first block where it is within the ball.  Items are named by their shingles.
    blocks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), block(F.col("fp"), k).alias("v")) for k in range(BLOCKS)]))
    window = window.select("doc_id", "m", "held", "start", "wh", "fp", blocks.alias("b")).select("*", F.col("b.k").alias("k"), F.col("b.v").alias("v")).drop("b")
    item = item.withColumn("name", F.xxhash64("ih"))
    coded = item.dropDuplicates(["name"]).select("name", F.col("m").alias("im"), simhash(F.col("ih"), F.col("m"), lane).alias("ifp"))
    near = F.array(*map(F.lit, NEAR))

    def stand(k: int) -> Column:
        return F.transform(near, lambda x: F.struct(F.lit(k).alias("k"), block(F.col("ifp"), k).bitwiseXOR(x).alias("v")))

    stands = F.explode(F.flatten(F.array(*[stand(k) for k in range(BLOCKS)])))
    coded = coded.select("name", "im", "ifp", stands.alias("b")).select("name", "im", "ifp", F.col("b.k").alias("ik"), F.col("b.v").alias("iv"))
    pair = window.join(small(coded), (window["k"] == coded["ik"]) & (window["v"] == coded["iv"]) & (window["m"] == coded["im"]))
    differ = F.col("fp").bitwiseXOR(F.col("ifp"))
    for k in range(BLOCKS - 1):
        pair = pair.where((F.col("k") <= k) | (F.bit_count(block(differ, k)) > BALL))
    pair = pair.where(F.bit_count(differ) <= RADIUS).select("doc_id", "m", "held", "start", "wh", "name")
    pair = pair.join(small(item.select("item_id", "name", numbered(F.col("ih")).alias("ih"))), "name")
    shared = F.size(F.array_intersect(numbered(F.col("wh")), F.col("ih")))
    pair = pair.select("doc_id", "item_id", "start", (F.col("held") + (SHINGLE - 1)).alias("n_words"), (shared / (F.col("m") + F.col("held") - shared)).alias("similarity"))
    return pair.where(F.col("similarity") >= SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item (rows with a null doc_id stay unless one of them does)."""
    return keep_rows(docs, "doc_id", find_leaks(spark, docs, items).select("doc_id"), "left_anti")
