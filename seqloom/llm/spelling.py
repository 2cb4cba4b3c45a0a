"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

One edit leaves one of two disjoint chunks of a word as it is. So the shorter word of a pair (of equal
length: the smaller one) contributes its two halves, and the other one positional grams of these
lengths. A half moves by no place if the edit comes after it, and by the difference of the lengths, one
at most, if it comes before; of all positional grams those at other places cannot join and are not
written. Halves and grams meet by an equality join whose condition verifies the pair: of the other
half one of two pieces must be equal too (their hashes are compared first), and the edit distance
must be one. So only true pairs leave the join.

A chunk that very many words share is cut into blocks on both sides, so that no task gets them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.session import materialize, materialize_with

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 4096
_MOST_HOT = 50_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def letter_runs(text: Column, least: int = 1) -> Column:
    """The maximal runs of at least ``least`` Latin letters, as an array; null text gives null."""
    return F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), 0)


def count_words(words: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """Column ``word`` with one row an occurrence -> word, n of the long and repeated ones."""
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _pieces(place: str) -> list[str]:
    """Hashes of two pieces of the other half; ``place`` moves what comes after the edit."""
    head = "if(half = 0, hash(substring(word, size div 2 + 1, (size - size div 2) div 2)), hash(substring(word, 1, size div 2 div 2))) as head"
    tail = f"""if(half = 0, hash(substring(word, size div 2 + (size - size div 2) div 2 + 1 + {place})),
               hash(substring(word, size div 2 div 2 + 1 + {place}, size div 2 - size div 2 div 2))) as tail"""
    return [head, tail]


def _chunks(words: DataFrame) -> DataFrame:
    """size, half, gram, head, tail, a, n_a: both halves of every word."""
    halves = words.select("word", "n", F.length("word").alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    gram = "if(half = 0, substring(word, 1, size div 2), substring(word, size div 2 + 1)) as gram"
    return halves.selectExpr("size", "half", gram, *_pieces("0"), "word as a", "n as n_a")


def _grams(words: DataFrame, least_length: int) -> DataFrame:
    """size, half, gram, head, tail, b, n_b: the grams of a word that a half of a word of ``size``
    letters, ``size`` being its length or one less, can equal after one edit in the other half."""
    sized = words.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("size", F.length("word") - F.col("shift"))
    halves = sized.filter(F.col("size") >= least_length).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    gram = "if(half = 0, substring(word, 1, size div 2), substring(word, size div 2 + 1 + shift)) as gram"
    return halves.selectExpr("size", "half", gram, *_pieces("shift"), "word as b", "n as n_b")


def near_pairs(words: DataFrame, least_length: int = 7) -> DataFrame:
    """word, n (one row a word) -> a, n_a, b, n_b: each pair exactly one edit apart, once (written)."""
    key = ["size", "half", "gram"]
    chunks, grams = _chunks(words), _grams(words, least_length)
    figures = chunks.select(*key, F.lit(1).alias("as"), F.lit(0).alias("bs")).unionByName(
        grams.select(*key, F.lit(0).alias("as"), F.lit(1).alias("bs"))
    )
    sums = figures.groupBy(*key).agg(F.sum("as").alias("as"), F.sum("bs").alias("bs")).filter("as > 0 and bs > 0")
    # A key is hot from a share of all rows on, so there are at most _MOST_HOT hot keys to broadcast.
    total = chunks.count() + grams.count()
    bound = max(_BLOCK, total // _MOST_HOT + 1)
    hot = materialize(
        sums.filter(F.greatest("as", "bs") > bound).select(
            *key, *[F.ceil(F.col(c) / F.lit(bound)).cast("int").alias(f"{c}_blocks") for c in ("as", "bs")]
        ),
        "hot-chunks",
    )

    def dealt(side: DataFrame, word: str, own: str, other: str) -> DataFrame:
        """Rows with their block; those of hot keys go to every block of the other side."""
        blocks = side.join(F.broadcast(hot), key, "left").fillna(1, ["as_blocks", "bs_blocks"])
        blocks = blocks.withColumn(own, F.pmod(F.xxhash64(word), F.col(f"{own}_blocks")).cast("int"))
        return blocks.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).drop("as_blocks", "bs_blocks")

    left, right = dealt(chunks, "a", "as", "bs"), dealt(grams, "b", "bs", "as")
    longer = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    piece = (left["head"] == right["head"]) | (left["tail"] == right["tail"])
    both = left.join(right, [*key, "as", "bs"]).filter(piece & longer & (F.levenshtein("a", "b", 1) == 1))
    return materialize(both.select("a", "n_a", "b", "n_b").distinct(), "near-words")


def _roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the end of each word's way along forms, by pointer doubling."""
    table, seen = materialize_with(
        forms.select("word", F.col("form").alias("root")), "word-roots", {"n": F.count(F.lit(1))}
    )
    moved = seen["n"]
    while moved:
        onward = table.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = table.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")
        )
        table, seen = materialize_with(step, "word-roots", {"n": F.count_if("went")})
        table, moved = table.drop("went"), seen["n"]
    return table


def spelling_variants(words: DataFrame, least_length: int = 7, ratio: int = 10) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    ``words`` has one row a word (word, n); null words and words under ``least_length`` code points
    (2 at least) are left out. n_near counts the words exactly one inserted, deleted or replaced
    code point away. ``form`` is the one of them with the largest n (ties: the smallest in
    code-point order) where that is ``ratio`` times the word's own n or more; ``root`` follows forms
    to the last. An empty table gives an empty one; further columns are ignored.
    """
    if least_length < 2 or ratio < 2:
        raise ValueError("least_length and ratio must be 2 at least")
    own = materialize(
        words.select(F.col("word").cast("string"), F.col("n").cast("bigint")).filter(F.length("word") >= least_length), "words"
    )
    pairs = near_pairs(own, least_length)
    ends = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
            )
        )
    )
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    linked = materialize(ends.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best), "linked-words")
    formed = (-F.col("best.rank")) >= F.lit(ratio) * F.col("n")
    linked = linked.select(
        "word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.rank")).alias("form_n")
    )
    roots = _roots(linked.filter("form is not null"))
    return (
        own.join(linked, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    )
