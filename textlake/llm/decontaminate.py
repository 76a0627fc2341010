"""Benchmark decontamination in DataFrame expressions: SimHash of item-sized windows, multi-index Hamming
blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.runtime import drop_extra, materialize

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
#: Fingerprints up to RADIUS bits apart are candidates: RADIUS + 1 blocks, of which one at least is equal.
RADIUS = 19
#: A benchmark with more shingles than this is joined by a shuffle instead of a broadcast.
BROADCAST_SHINGLES = 500_000


def with_words(df: DataFrame, out: str) -> DataFrame:
    """Adds the words of ``text`` in lower case; null text has none."""
    df = df.withColumn("_trimmed", F.lower(F.btrim("text", F.lit(BLANKS))))
    none = F.array().cast("array<string>")
    return df.withColumn(out, F.when(F.col("_trimmed") == "", none).otherwise(F.split("_trimmed", SPACE))).drop("_trimmed")


def stride(n: int, shingle: int, similarity: float) -> int:
    """The widest stride of places that still meets each similar window of n words in a shared shingle.

    Of its g shingles a window may have at most g - 2 * similarity * g / (1 + similarity) that the item lacks;
    one more place than that must be looked at.
    """
    g = max(1, n - shingle + 1)
    lacking = g - ceil(2 * similarity * g / (1 + similarity) - 1e-9)
    return max(1, g // (lacking + 1))


def gram_hashes(words: Column, k: int, step: int = 1) -> Column:
    """Hash of the k words at every ``step``-th place where k words are left."""
    places = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def with_simhash(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: 64 bits, each set where over half of the words' hashes have it; a word counts as often as
    it stands there. The hashes are a column of their own, read for each bit instead of made for each bit."""
    hashes = F.col("_hashes")

    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0).cast("long"), lambda c, h: c + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long")))
        return acc.bitwiseOR(F.call_function("shiftleft", F.when(2 * ones > F.size(hashes), F.lit(1)).otherwise(F.lit(0)).cast("long"), b))

    df = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    return df.withColumn(out, F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)).drop("_hashes")


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """(block number, its bits) of RADIUS + 1 blocks that divide the 64 bits as evenly as can be."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)).alias("bits"))
            for i in range(n)
        ]
    )


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater counts of each shingle."""
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    counted = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h)))
    single = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(single, F.size(F.array_intersect(a, b))).otherwise(counted)
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def _shingles(words: Column, n: Column, k: int) -> Column:
    """The k-word shingles; of fewer words, the whole sequence is one."""
    whole = F.array(F.xxhash64(F.concat_ws(" ", words)))
    return F.when(n < k, whole).otherwise(gram_hashes(words, k))


def _windows(d: DataFrame, b: DataFrame, shingle: int, similarity: float, broadcast_shingles: int) -> DataFrame:
    """doc_id, text_hash, start_word, window: windows of each item length around the places where a document
    has a shingle of an item of that length; every window similar to any item is among them."""
    lengths = [r.n for r in b.select("n").distinct().collect()]  # as many as there are lengths of items
    total = b.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0))).first()[0]
    out = None
    for k in sorted({min(n, shingle) for n in lengths}):  # items shorter than a shingle have their own length
        step = min(stride(n, shingle, similarity) for n in lengths if min(n, shingle) == k)
        # outer generators: the filter that an inner one implies would be pushed below and make all hashes twice
        keys = b.where(F.col("k") == k).select("n", "slack", F.posexplode_outer(gram_hashes(F.col("item"), k)).alias("off", "h")).distinct()
        places = F.posexplode_outer(gram_hashes(F.col("words"), k, step)).alias("i", "g")
        start = F.col("i") * step - F.col("off")
        around = F.explode_outer(F.sequence(start - F.col("slack"), start + F.col("slack"))).alias("s")
        inside = F.greatest(F.least(F.col("s"), F.size("words") - F.col("n")), F.lit(0)).alias("start_word")
        if total <= broadcast_shingles:
            met = d.select("doc_id", "text_hash", "words", places).join(F.broadcast(keys), F.col("g") == F.col("h"))
            met = met.select("doc_id", "text_hash", "words", "n", around)
        else:  # only numbers are dealt out; the words of the documents that are met come back afterwards
            met = d.select("doc_id", "text_hash", places).join(keys, F.col("g") == F.col("h"))
            met = met.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n", around).distinct()
            met = d.dropDuplicates(["doc_id", "text_hash"]).join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
        met = met.select("doc_id", "text_hash", "words", "n", inside)
        own = met.select("doc_id", "text_hash", "start_word", F.slice("words", F.col("start_word") + 1, F.col("n")).alias("window"), "n").distinct()
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = d.select("doc_id", "text_hash", F.lit(0).alias("start_word"), F.col("words").alias("window"), F.lit(0).alias("n")).limit(0)
    return out


def _found(docs: DataFrame, benchmark: DataFrame, shingle: int, similarity: float, radius: int, broadcast_shingles: int) -> DataFrame:
    b = with_words(drop_extra(benchmark, "item_id", "text"), "item").select("item_id", "item", F.size("item").alias("n")).where("n > 0")
    b = with_simhash(b, "item", "item_fp")
    g = F.greatest(F.col("n") - (shingle - 1), F.lit(1))
    # each word that a window has too many or too few before a shared shingle costs it one shingle at least
    slack = (g - F.ceil(F.lit(2 * similarity / (1 + similarity)) * g - 1e-9)).cast("int")
    b = materialize(b.select("item_id", "n", slack.alias("slack"), F.least("n", F.lit(shingle)).alias("k"), "item_fp", _shingles(F.col("item"), F.col("n"), shingle).alias("item_shingles"), "item"))
    d = with_words(drop_extra(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text")), "words").select("doc_id", "text_hash", "words")
    windows = materialize(with_simhash(_windows(d, b, shingle, similarity, broadcast_shingles), "window", "fp"))
    # the index: any item of the window's length that agrees with it in a block is a candidate
    index = b.select("item_id", "item_fp", "item_shingles", F.col("n").alias("_n"), F.explode_outer(blocks(F.col("item_fp"), radius)).alias("_b"))
    index = index.select("item_id", "item_fp", "item_shingles", "_n", F.col("_b.block").alias("_block"), F.col("_b.bits").alias("_bits"))
    if b.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0))).first()[0] * (radius + 1) <= broadcast_shingles:
        index = F.broadcast(index)
    marked = windows.select("doc_id", "text_hash", "start_word", "window", "n", "fp", F.explode_outer(blocks(F.col("fp"), radius)).alias("_b"))
    marked = marked.select("doc_id", "text_hash", "start_word", "window", "n", "fp", "_b.block", "_b.bits")
    pairs = marked.join(index, (F.col("n") == F.col("_n")) & (F.col("block") == F.col("_block")) & (F.col("bits") == F.col("_bits")))
    # a pair that agrees in several blocks goes on from the first of them
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.array_position(F.transform(blocks(differ, radius), lambda x: x["bits"]), F.lit(0).cast("long")) - 1
    pairs = pairs.where((F.bit_count(differ) <= radius) & (F.col("block") == first))
    size = F.size("window")
    near = pairs.select("doc_id", "text_hash", "item_id", "start_word", "item_shingles", F.bit_count(differ).alias("hamming"), size.alias("n"), _shingles(F.col("window"), size, shingle).alias("window_shingles"))
    near = near.withColumn("similarity", weighted_jaccard(F.col("item_shingles"), F.col("window_shingles"))).where(F.col("similarity") >= similarity)
    return near.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), (-F.col("hamming")).alias("d"), "n")).alias("_best"))


def find(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: for each document and benchmark item that
    it contains, the most similar window.

    A window has as many words as an item. A window similar to an item shares nearly all shingles with it, so
    looking up every ``stride``-th place of a document meets each of them; the windows around such a place, as
    far as words may be missing or too many, get a SimHash. The index of all items' fingerprints is asked for
    each window: items of its length whose hash agrees in one of ``radius`` + 1 blocks (all up to ``radius``
    bits apart do) are candidates, whichever item's shingle led there, and the weighted Jaccard similarity of
    their ``shingle``-word shingles has to reach ``similarity``. Case is folded.

    Null or empty text, an item without words: nothing found. An item shorter than a shingle: its whole
    sequence is one. Repeated documents or items: the best window of each pair of ids, once; ties: the first
    window. A document shorter than the item, or a passage at its edge: the window is moved inside and may be
    the whole text. Empty tables: no rows. Extra columns of any name are left alone.
    """
    found = _found(docs, benchmark, shingle, similarity, radius, broadcast_shingles).groupBy("doc_id", "item_id").agg(F.max("_best").alias("_best"))
    return found.select(
        "doc_id", "item_id", (-F.col("_best.s")).cast("long").alias("start_word"), F.col("_best.n").cast("long").alias("n_words"),
        (-F.col("_best.d")).cast("long").alias("hamming"), F.round("_best.similarity", 6).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns as they were.

    Each row goes by its own text: rows that only share an id, or have none, with a leaking one stay. Null and
    empty texts stay; an empty benchmark leaves all rows, an empty table none. Extra columns may have any names.
    """
    hit = materialize(_found(docs, benchmark, 5, 0.8, RADIUS, BROADCAST_SHINGLES).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("hash"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_anti").select("row.*")
