"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become template tokens: numbers, names (capitalised words inside a sentence) and units after numbers
turn into typed placeholders, everything else is folded and freed of punctuation. Windows of ``WINDOW``
template tokens of benchmark items are hash-joined with those of documents, so a question with other
numbers and names matches, too. Along each alignment (document, item, shift) the slots must be consistent:
one number or name of the item always meets one of the document; two may become the same, and units may
change. Windows without slots, and those with the item's own values, count in any alignment. A document is
contaminated by an item if the windows that count in one alignment cover ``least`` of the item's tokens, or all
of a shorter item. Rows of the benchmark that share an item_id, or have none, but not a text are items of their
own, reported under that id.

Windows of fewer than ``LITERALS`` different words that aren't placeholders say too little and are left out.
Items whose other windows can't cover enough, and those of fewer than ``WINDOW`` tokens, match where a
document has their whole sequence of folded words, however short. An item's first word is also looked for as
the name that it seems to be after lower-case text. Null and empty texts match nothing; repeated rows match
alike and are reported once; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, stored

WINDOW, LITERALS, LEAST = 8, 5, 12
#: Rows of benchmark windows up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000
#: Words that count as units after a number.
UNITS = "m cm mm km ft feet inch inches mile miles yard yards g kg mg lb lbs oz ton tons l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros pound pounds cent cents usd eur gbp mph kmh degrees celsius fahrenheit".split()
_PUNCTUATION = ".,;:!?\"'()[]{}|#$%&*<>/\\_=+~^@`“”„‘’«»…–—-"
_NAME, _NUMBER, _UNIT = "\u0001", "\u0002num", "\u0002unit"


def tokens(text: Column, names: bool = True) -> Column:
    """Folded words; a name keeps a mark in front where names are asked for."""
    marked = F.regexp_replace(text, r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+", "\u0001$0") if names else text
    joined = F.regexp_replace(marked, r"(?<=[0-9])[.,](?=[0-9])", "")
    bare = F.lower(F.translate(joined, _PUNCTUATION + "\t\n\x0b\f\r", " " * (len(_PUNCTUATION) + 5)))
    return F.filter(F.split(bare, " "), lambda w: w != "")


def template(words: Column) -> Column:
    """Hashes of template tokens."""

    def one(w: Column, i: Column) -> Column:
        digit = lambda x: x.between("0", "9￿")
        kind = F.when(w.startswith(_NAME), _NAME).when(digit(w), _NUMBER).when((i > 0) & digit(F.get(words, i - 1)) & w.isin(UNITS), _UNIT)
        return F.xxhash64(F.coalesce(kind, w))

    return F.transform(words, one)


def _slots(kind: Column) -> list[Column]:
    return [kind == F.xxhash64(F.lit(x)) for x in (_NAME, _NUMBER, _UNIT)]


def _once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """keep and computed columns. They come out of a generator, so that the optimiser can't move their expressions into
    functions of array elements, where they would be evaluated for every element."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def windows(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, at (place of the window), w (its hash), words (raw tokens of windows with slots), n_tokens."""
    hashed = _once(_once(rows, list(keys), t=tokens(F.col("text"))).where(F.size("t") >= WINDOW), [*keys, "t"], h=template(F.col("t")))
    is_slot = F.transform("h", lambda x: reduce(lambda a, b: a | b, _slots(x)))
    cut = _once(hashed, [*keys, "t", "h"], slot=is_slot)
    cut = _once(cut, [*keys, "t", "h", "slot"], slotted=F.array_contains("slot", True))
    own = lambda column, i: F.slice(column, i, WINDOW)

    def window(i: Column) -> Column:
        # a hash of an array is that of its elements as columns; no function is called for each element of a window
        words = F.when(F.col("slotted") & F.array_contains(own("slot", i), True), own("t", i))
        return F.struct(F.xxhash64(own("h", i)).alias("w"), words.alias("words"))

    every = F.transform(F.sequence(F.lit(1), F.size("t") - (WINDOW - 1)), window)
    cut = cut.select(*keys, F.size("t").alias("n_tokens"), F.posexplode(every).alias("at", "x"))
    return cut.select(*keys, "n_tokens", "at", "x.w", "x.words")


def _items(benchmark: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("item_key"), text.alias("text"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The telling windows of the items, and each window's template hashes of slots' places; an item's first window comes
    twice if its first word would be a name inside a sentence (inner)."""
    items = _items(benchmark)
    opens = F.col("text").rlike(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}")
    t = _once(items, ["item_id", "item_key"], t=tokens(F.col("text")), opens=opens).where(F.size("t") >= WINDOW)
    t = _once(t, ["item_id", "item_key", "t", "opens"], h=template(F.col("t")))
    at = t.select("item_id", "item_key", F.size("t").alias("item_tokens"), "t", "h", "opens", F.explode(F.sequence(F.lit(0), F.size("t") - WINDOW)).alias("item_at"))
    own = F.slice("h", F.col("item_at") + 1, WINDOW)
    is_slot = F.transform(own, lambda y: reduce(lambda a, b: a | b, _slots(y)))
    w = lambda first: F.xxhash64(first, *(F.get("h", F.col("item_at") + k) for k in range(1, WINDOW)))
    words = F.slice("t", F.col("item_at") + 1, WINDOW)
    plain = F.struct(w(F.get("h", F.col("item_at"))).alias("item_w"), words.alias("item_words"), is_slot.alias("is_slot"), F.lit(False).alias("inner"))
    named = F.concat(F.array(F.concat(F.lit(_NAME), F.get("t", F.lit(0)))), F.slice("t", 2, WINDOW - 1))
    inner = F.struct(w(F.xxhash64(F.lit(_NAME))).alias("item_w"), named.alias("item_words"), F.concat(F.array(F.lit(True)), F.slice(is_slot, 2, WINDOW - 1)).alias("is_slot"), F.lit(True).alias("inner"))
    both = F.when(F.col("opens") & (F.col("item_at") == 0), F.array(plain, inner)).otherwise(F.array(plain))
    full = at.select("item_id", "item_key", "item_tokens", "item_at", own.alias("own"), F.inline(both))
    literal = F.size(F.array_distinct(F.filter("own", lambda y: ~reduce(lambda a, b: a | b, _slots(y)))))
    return full.where(literal >= LITERALS).drop("own").dropDuplicates(["item_id", "item_key", "item_at", "inner"])


def _covered() -> Column:
    return F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("item_at", F.col("item_at") + (WINDOW - 1)))))).cast("long")


def whole_matches(docs: DataFrame, benchmark: DataFrame, telling: DataFrame, least: int) -> DataFrame | None:
    """doc_id, row_key, item_id, n_windows (places), n_covered, n_item_tokens, n_slots of documents with the whole word sequence
    of an item that its telling windows can't find; None without such items. One hash a place and length of these items."""
    items = _once(_items(benchmark), ["item_id", "item_key"], t=tokens(F.col("text"), names=False)).where(F.size("t") > 0)
    able = telling.groupBy(F.col("item_id").alias("able"), F.col("item_key").alias("able_key")).agg(_covered().alias("most"))
    items = items.join(able, F.col("item_id").eqNullSafe(F.col("able")) & (F.col("item_key") == F.col("able_key")), "left").where(F.coalesce("most", F.lit(0)) < F.least(F.lit(least), F.size("t")))
    items = stored(items.select("item_id", F.size("t").alias("item_tokens"), F.xxhash64("t").alias("item_w")).distinct())
    lengths = sorted(r[0] for r in items.select("item_tokens").distinct().collect())
    if not lengths:
        return None
    if items.count() <= BROADCAST_ROWS:
        items = F.broadcast(items)
    own = _once(documents(docs).select("doc_id", "row_key", "text"), ["doc_id", "row_key"], t=tokens(F.col("text"), names=False)).where(F.size("t") >= lengths[0])
    size = F.explode(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.size("t"))).alias("n")
    sized = own.select("doc_id", "row_key", "t", size)
    places = sized.select("doc_id", "row_key", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1), lambda i: F.xxhash64(F.slice("t", i, F.col("n"))))).alias("w"))
    met = places.join(items, (places.w == items.item_w) & (places.n == items.item_tokens))
    return met.groupBy("doc_id", "row_key", "item_id").agg(F.count("*").alias("n_windows"), F.max("item_tokens").cast("long").alias("n_covered"), F.max("item_tokens").cast("long").alias("n_item_tokens"), F.lit(0).cast("long").alias("n_slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, row_key, item_id, n_windows, n_covered, n_item_tokens, n_slots of every contaminated pair."""
    telling = items = stored(item_windows(benchmark))
    if items.count() <= BROADCAST_ROWS:
        items = F.broadcast(items)
    own = windows(documents(docs).select("doc_id", "row_key", "text"), "doc_id", "row_key")
    met = own.join(items, own.w == items.item_w).select("doc_id", "row_key", "item_id", "item_key", "item_tokens", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), "words", "item_words", "is_slot", "inner").distinct()
    met = met.where(~F.col("inner") | (F.get("words", F.lit(0)) == F.get("item_words", F.lit(0))))  # the first word itself, not any name
    met = stored(met)  # matches only; read twice below
    pairs = met.where(F.col("words").isNotNull()).select("doc_id", "row_key", "item_id", "item_key", "shift", F.explode(F.filter(F.arrays_zip("words", "item_words", "is_slot"), lambda z: z["is_slot"])).alias("z")).select("doc_id", "row_key", "item_id", "item_key", "shift", F.col("z.item_words").alias("mine"), F.col("z.words").alias("theirs")).distinct()
    line = ["doc_id", "row_key", "item_id", "item_key", "shift"]
    bound = F.col("mine").startswith(_NAME) | F.col("mine").between("0", "9￿")  # names and numbers differ in form, so one count serves both
    slots = pairs.groupBy(*line).agg(F.count("*").alias("n_slots"), F.count_if(bound).alias("n_bound"), F.count_distinct(F.when(bound, F.col("mine"))).alias("n_mine"))
    slots = slots.select(*(F.col(c).alias(f"s_{c}") for c in line), "n_slots", (F.col("n_mine") == F.col("n_bound")).alias("consistent"))
    same = reduce(lambda a, b: a & b, (met[c].eqNullSafe(slots[f"s_{c}"]) for c in line))
    own_values = F.col("words").isNull() | (F.col("words") == F.col("item_words"))
    good = met.join(slots, same, "left").where(F.coalesce("consistent", F.lit(True)) | own_values)
    lines = good.groupBy(*line).agg(_covered().alias("n_covered"), F.count_distinct("item_at").alias("n_windows"), F.max("item_tokens").cast("long").alias("n_item_tokens"), F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"))
    lines = lines.where(F.col("n_covered") >= F.least(F.lit(least), F.col("n_item_tokens")))
    best = F.max(F.struct("n_covered", "n_windows", "n_item_tokens", "n_slots")).alias("best")
    names = ["n_windows", "n_covered", "n_item_tokens", "n_slots"]
    per = lines.groupBy("doc_id", "row_key", "item_id").agg(best).select("doc_id", "row_key", "item_id", *(F.col(f"best.{c}").alias(c) for c in names))
    whole = whole_matches(docs, benchmark, telling, least)
    if whole is None:
        return per
    pair = ["doc_id", "row_key", "item_id"]
    return per.unionByName(whole).groupBy(*pair).agg(*(F.max(c).alias(c) for c in per.columns if c not in pair))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """docs, all columns, without the contaminated."""
    bad = contaminated(docs, benchmark, least).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    keyed = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return keyed.join(bad, keyed.doc_id.eqNullSafe(bad["__id"]) & (keyed["__row"] == bad["__key"]), "left_anti").drop("__row")
