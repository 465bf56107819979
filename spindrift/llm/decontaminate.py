"""Benchmark decontamination with SimHash windows, DataFrame functions only.

Words are runs of letters and digits of the lower-cased text, shingles are five words (all words of
an item that has fewer). For every benchmark item, windows of the item's size are taken from each
document; a window and an item match if their weighted-shingle similarity (the sum of the smaller
counts over the sum of the larger counts) is 0.8 or more.

1. Anchors. A window that matches shares a shingle with its item, and sliding it forward to its
   first shared shingle only drops shingles that don't count (at the end of a document, backward
   to its last window). So windows that start at a benchmark shingle, and the last one, suffice.
2. Equal windows are one row from here on, however many documents hold them.
3. SimHash. Windows and items of the same size are joined through a multi-index: the 64 bits are
   cut into radius + 1 blocks, one of which must be equal within the radius, so all pairs of
   fingerprints within it are found; the rest are dropped by their Hamming distance. The radius of
   20 bits lies over 3.5 standard deviations above the expected distance at similarity 0.8.
4. The exact similarity decides.

What is broadcast has at most ``MAX_BROADCAST`` values of 8 bytes, else it is joined by a shuffle.
Only documents with an anchor are cut into words again.

Defined cases: a null or empty text holds no window, and a null or empty item matches nothing; a
document shorter than an item is one window as a whole; a text of any length is read whole, and a
row gathers at most the windows of one text; rows of one id (a null id is one, too) give one row an
item, with the best window of all their texts; repeated rows count once, and ties of the best window
go to the first; empty tables give an empty result; only the named columns are read, so extra
columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
#: Values of 8 bytes that may be broadcast.
MAX_BROADCAST = 4_000_000


def _bounded(df: DataFrame, lists: str | None = None, width: int = 2) -> DataFrame:
    """``df``, to be broadcast if it is small: ``width`` values a row, and as many for each entry of
    the column ``lists``."""
    rows, entries = df.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0)).collect()[0]
    return F.broadcast(df) if (rows + entries) * width <= MAX_BROADCAST else df


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: as a lambda's variable, it isn't copied to
    the places that use it, as the optimizer may do with a column."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles_of(words: Column, size: int) -> Column:
    """Struct of ``n``, the number of words, and ``shingles``, the hashes of their runs of
    ``size``, in order."""

    def body(hashes):
        at = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size)))
        n = F.size(hashes)
        runs = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), at)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.alias("n"), runs.alias("shingles"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), body)


def _simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``fp`` of the exploded shingles ``s`` by ``keys``: bit b is 1 if set in over half of them."""
    ones = [F.sum(F.shiftright("s", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    bits = rows.groupBy(*keys).agg(F.count("*").alias("n"), *ones)
    fp = F.lit(0).cast("bigint")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint"))
    return bits.select(*keys, fp.alias("fp"))


def _blocks(fp: Column, radius: int) -> Column:
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    block = lambda i: F.shiftright(fp, edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1))
    return F.array(*(F.lit(i * 256).cast("bigint") + block(i) for i in range(radius + 1)))


def _similarity(a: Column, b: Column) -> Column:
    """Of two arrays of shingles as multisets."""
    common = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda c, s: F.size(F.filter(c, lambda x: x == s))
    shared = F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda n, s: n + F.least(times(a, s), times(b, s))))
    return shared / (F.size(a) + F.size(b) - shared)


def _sized(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where("item_id is not null and size(words) > 0").distinct()
    return items.select("item_id", "words", F.size("words").alias("m"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row a document and item that match: the best window's start (in words), size and
    similarity."""
    items = checkpointed(_sized(benchmark, item_col, item_text))
    found = None
    for k in sorted(r.k for r in items.select("k").distinct().collect()):  # 5, and 1 to 4 for short items
        part = _matches(docs, items.where(F.col("k") == k), k, id_col, text_col, similarity, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind, item = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, `{item_col}` {item}, start bigint, size bigint, similarity double")
    best = found.groupBy("doc", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "size")).alias("x"))
    return best.select(F.col("doc").alias(id_col), F.col("item_id").alias(item_col), (-F.col("x.before")).cast("bigint").alias("start"), F.col("x.size").cast("bigint").alias("size"), F.round("x.similarity", 9).alias("similarity"))


def _matches(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str, similarity: float, radius: int) -> DataFrame:
    items = checkpointed(items.select("item_id", "m", shingles_of(F.col("words"), k)["shingles"].alias("shingles")))
    anchors = checkpointed(items.select("m", F.explode("shingles").alias("s")).groupBy("s").agg(F.collect_set("m").alias("sizes")))
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    shingled = lambda df, *more: df.select("doc", "th", *more, shingles_of(words_of(F.col("text")), k).alias("x")).select("doc", "th", *more, "x.n", "x.shingles")

    # 1. windows at anchors
    hits = shingled(texts).select("doc", "th", "n", F.posexplode("shingles").alias("at", "s")).join(_bounded(anchors, "sizes"), "s")
    windows = hits.select("doc", "th", "n", "at", F.explode("sizes").alias("m")).select("doc", "th", F.least("at", F.greatest(F.lit(0), F.col("n") - F.col("m"))).alias("start"), "m")
    by_doc = checkpointed(windows.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "m")).alias("windows")))
    cut = F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["m"].alias("m"), F.slice("shingles", w["start"] + 1, F.greatest(w["m"] - (k - 1), F.lit(1))).alias("shingles")))
    named = _bounded(by_doc.select(F.col("doc").alias("own"), F.col("th").alias("own_th"), "windows"), "windows")
    again = texts.join(named, (F.col("th") == F.col("own_th")) & F.col("doc").eqNullSafe(F.col("own")))
    windows = shingled(again, "windows").select("doc", F.explode(cut).alias("w")).select("doc", "w.*")
    windows = windows.withColumn("key", F.xxhash64("shingles")).withColumn("key2", F.xxhash64(F.lit(7), "shingles"))
    windows = checkpointed(windows)

    # 2. distinct windows, 3. fingerprints and multi-index
    distinct = windows.groupBy("m", "key", "key2").agg(F.any_value("shingles").alias("shingles"))
    prints = _simhash(distinct.select("m", "key", "key2", F.explode("shingles").alias("s")), ["m", "key", "key2"])
    own = _simhash(items.select("item_id", "m", F.explode("shingles").alias("s")), ["item_id", "m"])
    blocks = checkpointed(own.select("item_id", "m", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"), radius)).alias("block")))
    near = prints.select("*", F.explode(_blocks(F.col("fp"), radius)).alias("block")).join(_bounded(blocks, width=4), ["m", "block"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("m", "key", "key2", "item_id").distinct()

    # 4. exact similarity of the windows' and the items' shingles
    pairs = near.join(distinct, ["m", "key", "key2"]).join(items.select("item_id", "m", F.col("shingles").alias("wanted")), ["item_id", "m"])
    matched = pairs.withColumn("similarity", _similarity(F.col("shingles"), F.col("wanted"))).where(F.col("similarity") >= similarity)
    matched = checkpointed(matched.select("m", "key", "key2", "item_id", "similarity"))
    rows = windows.select("doc", "start", "m", "key", "key2").join(_bounded(matched, width=5), ["m", "key", "key2"])
    return rows.select("doc", "item_id", "start", F.col("m").alias("size"), "similarity")
