"""Substring join without a nested loop.

A needle is looked up through the one of its n-grams that is rarest among the haystacks, so the
join is an equi-join on that n-gram followed by an exact check. Every true pair is found: when
the needle lies in a haystack, so does each of its n-grams.

Texts are matched once each, whatever groups they occur in. Haystacks are cut into n-grams once, and those that no
needle has are dropped before any exchange, by a broadcast: of the needles' n-grams up to ``MOST_BROADCAST_GRAMS``, of the slots
that they fall in beyond. Only n-grams that a needle is looked up by are exchanged with their haystacks. An n-gram that very many
haystacks share is dealt over several tasks by a salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.session import stored

GRAM_SIZES = (8, 4, 2, 1)
# Hashes of 8 bytes each.
MOST_BROADCAST_GRAMS = 1_000_000
# Slots of one bit each, 64 to a word: a broadcast of at most a million words, whatever the number of n-grams.
SLOTS = 1 << 26
# Haystacks that one task cuts.
TASK_TEXTS = 100_000
# Haystacks of one n-gram in a task, at least; larger shares of all rows are dealt out, so at most 1,000 n-grams are.
SALT_ROWS, SALT_SHARE = 100_000, 1000


def _gram_size(text: Column) -> Column:
    """Largest usable n-gram of a needle."""
    rule = None
    for size in GRAM_SIZES:
        hit = F.length(text) >= size
        rule = F.when(hit, size) if rule is None else rule.when(hit, size)
    return rule


def _explode_grams(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct n-gram (its hash in column ``_gram``) of a text, sized by the row's ``_size``.

    Only the first place of an n-gram counts, so a text never meets the same n-gram twice.
    """
    size, starts = F.col("_size"), F.length(text) - F.col("_size") + 1
    placed = df.where(starts > 0).withColumn("_at", F.explode(F.sequence(F.lit(1), starts)))
    gram = F.substring(text, F.col("_at"), size)
    return placed.where(F.instr(F.col(text), gram) == F.col("_at")).withColumn("_gram", F.xxhash64(gram)).drop("_at", "_size")


def _anchor_grams(pins: DataFrame) -> DataFrame:
    """N-grams a needle may be looked up by: those that lie side by side, and the last one. Any of a needle's n-grams would do."""
    size, last = F.col("_size"), F.length("_pin") - F.col("_size") + 1
    placed = pins.withColumn("_at", F.explode(F.array_union(F.sequence(F.lit(1), last, size), F.array(last))))
    return placed.withColumn("_gram", F.xxhash64(F.substring("_pin", F.col("_at"), size))).drop("_at", "_size")


def _distinct(df: DataFrame, text: str, name: str, extra: list[str]) -> DataFrame:
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(text).alias(name), *extra)
    return rows if extra else rows.distinct()


def among(grams: DataFrame, wanted: DataFrame, outside: bool = False) -> DataFrame:
    """The n-grams (or other hashes, in column ``_gram``) that are in ``wanted`` (distinct); the others are dropped where they are made.
    Of very many wanted ones only the slots are compared, which lets a few others through; what follows joins on the n-gram itself.
    With ``outside`` those that the same call without it drops.
    """
    if wanted.count() <= MOST_BROADCAST_GRAMS:
        return grams.join(F.broadcast(wanted), "_gram", "left_anti" if outside else "left_semi")
    slot = F.pmod("_gram", F.lit(SLOTS))
    word, bit = F.shiftright(slot, 6).alias("_word"), slot.bitwiseAND(F.lit(63))
    words = wanted.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(_gram, {SLOTS}) & 63 as int)))").alias("_bits"))
    hit = F.getbit(F.coalesce("_bits", F.lit(0).cast("bigint")), bit)
    joined = grams.withColumn("_word", word).join(F.broadcast(words), "_word", "left" if outside else "inner")
    return joined.where(hit == (0 if outside else 1)).drop("_word", "_bits")


def haystack_grams(hay: DataFrame, sizes: Column, wanted: DataFrame) -> DataFrame:
    """The n-grams of the haystacks (column ``_hay``) that a needle has; the others are dropped where they are cut."""
    return among(_explode_grams(hay.withColumn("_size", F.explode(sizes)), "_hay"), wanted)


def _salted(grams: DataFrame, anchors: DataFrame, seen: DataFrame, rows: int) -> DataFrame:
    """Haystacks and needles that share an anchor; a hot anchor's haystacks lie in several tasks, with its needles in each."""
    chunk = max(SALT_ROWS, math.ceil(rows / SALT_SHARE))
    hot = seen.where(F.col("_seen") > chunk).select("_gram", F.ceil(F.col("_seen") / chunk).cast("int").alias("_salts"))
    if hot.isEmpty():
        return grams.join(anchors, "_gram")
    hot = F.broadcast(hot)  # at most SALT_SHARE rows
    salts = F.coalesce("_salts", F.lit(1))
    dealt = grams.join(hot, "_gram", "left").withColumn("_salt", F.pmod(F.xxhash64("_hay"), salts).cast("int")).drop("_salts")
    copies = anchors.join(hot, "_gram", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, ["_gram", "_salt"])


def containment_pairs(
    haystacks: DataFrame,
    needles: DataFrame,
    haystack: str,
    needle: str,
    within: list[str] | None = None,
    haystack_extra: list[str] | None = None,
    needle_extra: list[str] | None = None,
) -> DataFrame:
    """Distinct (``within``..., haystack, needle) rows where the haystack text contains the needle text.

    Empty needles match nothing. ``within`` names columns both sides must agree on; texts are matched
    without them and the pairs then joined with the groups of either text. Extra columns of a side come along; its texts must
    then be distinct.
    """
    pins = stored(_distinct(needles, needle, "_pin", needle_extra or []).withColumn("_size", _gram_size(F.col("_pin"))), "needles")
    pin_grams = stored(_anchor_grams(pins), "needle-grams")
    wanted = stored(pin_grams.select("_gram").distinct(), "wanted-grams")

    # Haystacks emit only sizes that occur.
    hay = stored(_distinct(haystacks, haystack, "_hay", haystack_extra or []), "haystacks")
    tasks = max(hay.sparkSession.sparkContext.defaultParallelism, math.ceil(hay.count() / TASK_TEXTS))
    hay = hay.repartition(tasks)  # cutting multiplies rows, so the few bytes of the texts do not tell how many tasks it takes
    sizes = pins.select("_size").distinct().agg(F.collect_set("_size")).scalar()
    grams = stored(haystack_grams(hay, sizes, wanted), "haystack-grams")

    seen = stored(grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_seen")), "gram-counts")
    extra = [F.first(c).alias(c) for c in needle_extra or []]
    anchors = stored(
        pin_grams.join(seen, "_gram", "left")
        .groupBy("_pin")
        .agg(F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_best"), *extra)
        .where("_best.n > 0")
        .withColumn("_gram", F.col("_best.gram")).drop("_best"),
        "anchors",
    )
    looked_up = stored(anchors.select("_gram").distinct(), "anchor-grams")
    found = _salted(among(grams, looked_up), anchors, seen, grams.count()).where(F.contains("_hay", "_pin"))
    pairs = found.select(
        F.col("_hay").alias(haystack), F.col("_pin").alias(needle), *(haystack_extra or []), *(needle_extra or []))
    if not within:
        return pairs
    mine = needles.select(*within, needle).distinct()
    own = haystacks.select(*within, haystack).distinct()
    return pairs.join(mine, needle).join(own, [*within, haystack]).select(*within, haystack, needle)
