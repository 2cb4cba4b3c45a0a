"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks, in SQL functions only.

Words are runs of letters and digits, lower-cased. An item of L words is given windows of W pairs
of neighbouring words, W being the largest power-of-two multiple of a stride g with W + g <= L, so
that wherever a text holds the item, one of the text's windows that begin at multiples of g lies
wholly inside. All W-pair windows of the items are indexed, so an unchanged passage has distance 0. Windows of
texts are sums of packed counters over exploded words, compiled by Spark and without a shuffle
other than the one that deals out the texts.

A 64-bit fingerprint has the majority of its word pairs' hash bits. Of two fingerprints that differ in
at most 7 bits, one of four 16-bit blocks differs in at most 1 bit: each item window is entered
under every block and every block with one bit flipped, each text window looks its four blocks up,
and all pairs within 7 bits are found.

Edits can move every wide window too far. So shortest windows of one shingle (5 words, or the whole
of a shorter item) at every word of the texts are looked up as well, at distance 0. Of each item the
heaviest shingles enter, until those left out weigh less than the threshold: a text that holds none
of them cannot reach it.

The passage around a found pair, as long as the item plus a margin, is then compared exactly: the
share of the item's weight in shingles (rarer among items: heavier) that the passage holds must
reach the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.llm.common import bounded, fresh, text_of, with_row_keys
from seqloom.session import materialize

RADIUS = 7
_FIELDS = 8  # eight counters of 8 bits in each of eight numbers
_ONES = int("01" * 8, 16)
_LARGEST = 64  # words of a window: no counter reaches the sign bit
_INDEX_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shape(n_words: int) -> tuple[int, int]:
    """Stride and window length for an item of so many words."""
    stride = 8
    while 2 * stride > n_words and stride > 1:
        stride //= 2
    width = stride
    while 2 * width + stride <= n_words and width < _LARGEST:
        width *= 2
    return stride, width


def _shape_columns(n: Column) -> tuple[Column, Column]:
    """``_shape`` of a column of word counts."""
    sizes = [1, 2, 4, 8]
    stride = reduce(lambda c, g: F.when(n >= 2 * g, F.lit(g)).otherwise(c), sizes, F.lit(1))
    width = stride
    for power in range(1, 8):
        w = stride * (1 << power)
        width = F.when((w + stride <= n) & (w <= _LARGEST), w).otherwise(width)
    return stride.cast("int"), width.cast("int")


def _hashed(rows: DataFrame) -> DataFrame:
    """Word pairs of ``words`` exploded: place ``_at`` and the groups of hash bits ``_f0`` to ``_f7``."""
    kept = [c for c in rows.columns if c != "words"]
    pairs = F.zip_with("_h", F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    hashed = rows.select(*kept, F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    return hashed.select(*kept, F.posexplode(pairs).alias("_at", "_pair")).select(
        *kept, "_at", *[F.shiftright("_pair", f).bitwiseAND(F.lit(_ONES)).alias(f"_f{f}") for f in range(_FIELDS)]
    )


def _added(*more: Column) -> list[Column]:
    return [*[F.sum(f"_f{f}").alias(f"_f{f}") for f in range(_FIELDS)], *more]


def _fingerprint(width: Column) -> Column:
    """A bit is set where more than half of a window's word pairs have it."""
    lift = F.lit(_ONES) * (63 - F.floor(width / 2))
    bits = [
        F.shiftleft(F.shiftright(F.col(f"_f{f}") + lift, 6).bitwiseAND(F.lit(_ONES)), f) for f in range(_FIELDS)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _text_windows(rows: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """doc_id, cls, at, fp of all windows of the texts; ``rows`` has _row, doc_id and words, and is
    partitioned by _row, so nothing is shuffled here: words add up to blocks of one stride, and
    blocks to the windows they are in."""
    out = []
    for stride in sorted({g for g, _ in shapes}):
        widths = sorted({w for g, w in shapes if g == stride})
        blocks = _hashed(rows).groupBy("_row", "doc_id", F.expr(f"_at div {stride}").alias("_block")).agg(*_added(F.count(F.lit(1)).alias("_n")))
        where = [
            F.struct(F.lit(_class_no(stride, w)).alias("cls"), F.lit(w).alias("width"), F.lit(back).alias("back"))
            for w in widths
            for back in range(w // stride)
        ]
        spread = blocks.withColumn("_in", F.explode(F.array(*where))).withColumn("_first", F.col("_block") - F.col("_in.back"))
        windows = (
            spread.filter("_first >= 0")
            .groupBy("_row", "doc_id", F.col("_in.cls").alias("cls"), F.col("_in.width").alias("width"), "_first")
            .agg(*_added(F.sum("_n").alias("_n")))
            .filter("_n = width")
        )
        out.append(windows.select("doc_id", "cls", (F.col("_first") * stride).cast("int").alias("at"), _fingerprint(F.col("width")).alias("fp")))
    return reduce(DataFrame.unionByName, out)


def _item_windows(items: DataFrame) -> DataFrame:
    """item_no, length, cls, at, fp of the windows at every word of the items, in their own shape."""
    keys = ["item_no", "length", "stride", "width"]
    spread = _hashed(items.select(*keys, "words")).withColumn(
        "_first", F.explode(F.sequence(F.col("_at") - F.col("width") + 1, F.col("_at")))
    )
    windows = spread.filter("_first >= 0 and _first + width < length").groupBy(*keys, "_first").agg(*_added())
    cls = reduce(
        lambda c, s: F.when((F.col("stride") == s[0]) & (F.col("width") == s[1]), F.lit(_class_no(*s))).otherwise(c),
        [(1 << a, 1 << b) for a in range(4) for b in range(a, 7)],
        F.lit(None).cast("int"),
    )
    return windows.select("item_no", "length", cls.alias("cls"), F.col("_first").alias("at"), _fingerprint(F.col("width")).alias("fp"))


def _short_windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """The columns of ``rows`` but ``words``, with at, size and key of every run of so many words."""
    kept = [c for c in rows.columns if c != "words"]
    longest = max(sizes)
    hashed = rows.select(*kept, F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    # Shifted copies side by side: the keys are then computed by compiled code.
    beside = F.arrays_zip(*[F.slice("_h", k + 1, F.greatest(F.size("_h"), F.lit(1))).alias(f"_h{k}") for k in range(longest)])
    runs = hashed.select(*kept, F.posexplode(beside).alias("at", "_run"))
    keys = [
        F.struct(F.lit(n).alias("size"), F.when(F.col(f"_run._h{n - 1}").isNotNull(), F.xxhash64(F.lit(n), *[f"_run._h{k}" for k in range(n)])).alias("key"))
        for n in sizes
    ]
    each = keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    return runs.select(*kept, "at", each.alias("_w")).select(*kept, "at", "_w.size", "_w.key").filter("key is not null")


def _short_index(items: DataFrame, weights: DataFrame, totals: DataFrame, sizes: list[int], threshold: float) -> DataFrame:
    """key, item_at and item_no of each item's heaviest shingles; those left out stay below the threshold."""
    heaviest = Window.partitionBy("item_no").orderBy(F.col("weight").desc(), F.xxhash64("shingle"), "shingle")
    before = F.sum("weight").over(heaviest.rowsBetween(Window.unboundedPreceding, -1))
    chosen = weights.withColumn("_before", F.coalesce(before, F.lit(0.0))).join(totals, "item_no")
    chosen = chosen.filter(F.col("_before") <= F.col("total") * (1 - threshold + 1e-6)).select("item_no", "shingle")
    runs = _short_windows(items.select("item_no", "shortest", F.col("words").alias("_words"), "words"), sizes).filter("size = shortest")
    runs = runs.select("item_no", "key", F.col("at").alias("item_at"), F.array_join(F.slice("_words", F.col("at") + 1, F.col("size")), " ").alias("shingle"))
    return runs.join(chosen, ["item_no", "shingle"]).select("key", "item_at", "item_no")


def _in_parts(index: DataFrame) -> list[DataFrame]:
    """The index is sent to the tasks in parts of bounded size; a larger benchmark takes more passes."""
    parts = -(-index.count() // _INDEX_ROWS)
    return [index if parts == 1 else index.filter(F.pmod(F.xxhash64("key", "item_no"), F.lit(parts)) == part) for part in range(parts)]


def _class_no(stride: int, width: int) -> int:
    return stride.bit_length() * 16 + width.bit_length()


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _key(cls: Column, k: int, bits: Column) -> Column:
    return F.shiftleft(cls * 4 + k, 16) + bits


def _each(count: Column, make) -> Column:
    """Array of ``make(i)`` for i from 0 to ``count`` - 1."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), make)).otherwise(F.array())


def _shingles(words: Column, size: int | Column) -> Column:
    """Distinct runs of ``size`` words as text; of fewer words, all of them as one."""
    n = F.size(words)
    runs = _each(n - size + 1, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    whole = F.when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(n >= size, runs).otherwise(whole))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    least_words: int = 2,
) -> DataFrame:
    """doc_id, item_id, similarity and place (first word of the best passage) of every leak.

    Every whole text is compared with every item of ``least_words`` words or more; items that share an id
    count as one with the best similarity, and so do rows that share a document id (null is an id of
    its own). Null or empty texts, and items of fewer words, leak nothing. An item shorter than a
    shingle leaks where all its words stand in a row.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(text_of(item_text)).alias("words")).filter(F.size("words") >= max(1, least_words))
    stride, width = _shape_columns(F.size("words"))
    items = items.withColumn("item_no", F.monotonically_increasing_id()).withColumn("stride", stride).withColumn("width", width)
    items = items.withColumn("shortest", F.least(F.lit(shingle), F.size("words")))
    items = materialize(items.withColumn("shingles", _shingles(F.col("words"), shingle)), "items")
    # Items of a single shingle have no wide windows: the shortest ones find them all.
    wide = items.withColumn("length", F.size("words")).filter(F.col("length") > shingle)
    shapes = [tuple(r) for r in wide.select("stride", "width").distinct().collect()]  # 4 strides, 8 widths at most
    sizes = sorted(r[0] for r in items.select("shortest").distinct().collect())
    rows = docs.select(F.col(doc_id).alias("doc_id"), words_of(text_of(text)).alias("words"))
    if not sizes:
        return rows.limit(0).select(
            "doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("place")
        )

    spread = items.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("in_items"))
    n_items = items.count()
    weighed = items.select("item_no", F.explode("shingles").alias("shingle")).join(spread, "shingle")
    weight = F.log1p(F.lit(float(n_items)) / F.col("in_items"))
    weights = materialize(weighed.select("item_no", "shingle", weight.alias("weight")), "item-weights")
    totals = weights.groupBy("item_no").agg(F.sum("weight").alias("total"))
    profile = materialize(items.select("item_no", "item_id", F.size("words").alias("length")).join(totals, "item_no"), "profiles")

    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), text_of(text).alias("_text"))
    shortest = _short_windows(texts.select("doc_id", words_of(F.col("_text")).alias("words")), sizes)
    found = []
    for chosen in _in_parts(materialize(_short_index(items, weights, totals, sizes, threshold), "item-shingles")):
        hits = shortest.join(F.broadcast(chosen), "key")
        found.append(hits.select("doc_id", "item_no", (F.col("at") - F.col("item_at")).alias("first")))
    if shapes:
        flips = [0, *(1 << i for i in range(16))]
        keys = F.explode(F.array(*[_key(F.col("cls"), k, _block(F.col("fp"), k).bitwiseXOR(F.lit(f))) for k in range(4) for f in flips]))
        index = materialize(
            _item_windows(wide).select(keys.alias("key"), F.col("fp").alias("item_fp"), F.col("at").alias("item_at"), "item_no"), "item-index"
        )
        texts = texts.repartition("_row").select("_row", "doc_id", words_of(F.col("_text")).alias("words"))
        probes = _text_windows(texts, shapes).withColumn("key", F.explode(F.array(*[_key(F.col("cls"), k, _block(F.col("fp"), k)) for k in range(4)])))
        for chosen in _in_parts(index):
            near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
            hits = probes.join(F.broadcast(chosen), (probes["key"] == chosen["key"]) & near)
            found.append(hits.select("doc_id", "item_no", (F.col("at") - F.col("item_at")).alias("first")))
    places = materialize(reduce(DataFrame.unionByName, found).distinct(), "leak-places")
    margin = F.greatest(F.lit(shingle), F.floor(F.col("length") / 8)).cast("int")
    by_doc = places.join(profile.select("item_no", "length"), "item_no").groupBy("doc_id").agg(
        F.collect_list(F.struct("item_no", "first", (F.col("first") - margin).alias("begin"), (F.col("length") + 2 * margin).alias("n"), F.least(F.lit(shingle), F.col("length")).alias("size"))).alias("_found")
    )
    by_doc = by_doc.withColumnRenamed("doc_id", "_id")
    by_doc = materialize(by_doc, "suspects")
    # Only the suspects' texts move, unless there are too many of them to send their ids.
    ids = bounded(by_doc.select(F.col("_id").alias("_suspect")))
    whole = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text")).join(ids, F.col("doc_id").eqNullSafe(F.col("_suspect")), "left_semi")
    suspects = whole.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")))
    # Exploding between the two steps keeps the words of a text from being found once per place.
    placed = suspects.select("doc_id", words_of(F.col("_text")).alias("words"), F.explode("_found").alias("f"))
    begin = F.greatest(F.col("f.begin"), F.lit(0))
    passages = placed.select(
        "doc_id",
        F.col("f.item_no").alias("item_no"),
        F.greatest(F.col("f.first"), F.lit(0)).alias("place"),
        F.slice("words", begin + 1, F.col("f.n") + F.least(F.col("f.begin"), F.lit(0))).alias("passage"),
        F.col("f.size").alias("size"),
    ).distinct()
    held = (
        passages.select("doc_id", "item_no", "place", F.explode(_shingles(F.col("passage"), F.col("size"))).alias("shingle"))
        .join(weights, ["item_no", "shingle"])
        .groupBy("doc_id", "item_no", "place")
        .agg(F.sum("weight").alias("held"))
    )
    compared = (
        held.join(profile, "item_no")
        .select("doc_id", "item_id", "place", (F.col("held") / F.col("total")).alias("similarity"))
        .filter(F.col("similarity") >= threshold - 1e-9)
    )
    return compared.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.min_by("place", F.struct(-F.col("similarity"), F.col("place"))).alias("place")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose own text leaks no item, with all their columns; ids do not matter."""
    keyed, names = with_row_keys(docs)
    columns = [c for c in keyed.columns if c not in names]
    key = fresh(keyed.columns, "_key")
    keyed = keyed.withColumn(key, F.struct(*names))
    found = leaks(keyed, benchmark, key, text, **options).select(F.col("doc_id").alias("_leaked")).distinct()
    dropped = bounded(materialize(found, "leaking-rows"))
    return keyed.join(dropped, keyed[key] == dropped["_leaked"], "left_anti").select(*[F.col(f"`{c}`") for c in columns])
