"""Passages of a benchmark that occur in documents, found by winnowing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: What separates words; A-Z become a-z, which belong to words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a gram whose hash is a fingerprint.
GRAM = 5
#: Low bits of a ranked hash that hold the gram's position.
POSITION_BITS = 30
#: Bits of a page of Spark's bitmap functions, and the most pages of a filter (4 MB).
PAGE, MOST_PAGES = 32_768, 1024

_POSITION = (1 << POSITION_BITS) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(text: Column) -> Column:
    """The words of a text as they are written; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _lower(word: Column) -> Column:
    """A-Z in lower case; ``lower`` changes A-Z alone where all characters are ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z in lower case; none for null."""
    return F.transform(_parts(text), _lower)


def _ranked(hashes: Column, window: int) -> Column:
    """The grams that winnowing keeps: the smallest of every ``window`` - ``GRAM`` + 1 adjacent ones, the leftmost of equals.

    A rank is the gram's hash with its low bits replaced by the position, so one
    comparison decides both, and windows that keep the same gram give equal ranks.
    """
    wide = window - GRAM + 1
    every = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, GRAM)]).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")))

    def smallest(ranks: Column) -> Column:
        least = F.transform(ranks, lambda r, i: F.least(r, *[F.get(ranks, i + j) for j in range(1, wide)])) if wide > 1 else ranks
        return F.array_distinct(_leading(least, wide - 1))

    return _bound(_leading(every, GRAM - 1), smallest)


def _leading(values: Column, without: int) -> Column:
    """All values but the last ``without``."""
    return F.slice(values, F.lit(1), F.greatest(F.size(values) - without, F.lit(0)))


def _whole_ranks(hashes: Column, length: int) -> Column:
    """Ranks of all grams of ``length`` words."""
    every = F.transform(hashes, lambda h, i: F.xxhash64(F.lit(length), h, *[F.get(hashes, i + j) for j in range(1, length)]).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")))
    return _leading(every, length - 1)


def _fingerprints(hashes: Column, length: int, window: int) -> Column:
    return _ranked(hashes, window) if length >= window else _whole_ranks(hashes, length)


def _value(rank: Column) -> Column:
    """The hash of a rank's gram."""
    return F.shiftright(rank, POSITION_BITS)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``item, words``: all windows of every item; an item of fewer words is one window."""
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    starts = F.when(F.size("words") >= window, F.sequence(F.lit(0), F.size("words") - window)).otherwise(F.array(F.lit(0)))
    return listed.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("words"), s + 1, window))).alias("words"))


def _filter_bits(values: DataFrame) -> tuple[Column, int]:
    """A bitmap of the fingerprints as a literal, and its number of bits.

    It grows with the fingerprints to 16 bits each, and to ``MOST_PAGES`` at most; a full
    one lets more grams through to the join, which decides. No fingerprint is missed.
    """
    pages = 1
    count = values.count()
    while pages < MOST_PAGES and pages * PAGE < 16 * count:
        pages *= 2
    bits = pages * PAGE
    place = F.pmod("value", F.lit(bits))
    found = values.groupBy((place / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(PAGE))).alias("map")).collect()
    maps = {r["page"]: bytes(r["map"]) for r in found}
    return F.lit(b"".join(maps.get(p, bytes(PAGE // 8)) for p in range(pages))), bits


def _may_hold(bitmap: Column, bits: int, value: Column) -> Column:
    place = F.pmod(value, F.lit(bits))
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _marked(docs: DataFrame, bitmap: Column, bits: int, lengths: list[int], window: int) -> DataFrame:
    """``docs`` (``_doc``, ``_text``) with ``_n_words`` and ``_grams``: the fingerprints that the bitmap lets through, each with the words around."""
    with_words = docs.withColumn("_words", _parts(F.col("_text")))
    words = F.col("_words")
    reach = window - GRAM

    def around(length: int):
        size, left = (GRAM, reach) if length >= window else (length, 0)

        def gram(rank: Column) -> Column:
            place = rank.bitwiseAND(F.lit(_POSITION)).cast("int")
            first = F.greatest(place - left, F.lit(0))
            near = F.transform(F.slice(words, first + 1, F.least(place, F.lit(left)) + size + left), _lower)
            return F.struct(_value(rank).alias("value"), F.lit(length).alias("length"), first.alias("first"), place.alias("place"), near.alias("around"))

        return gram

    def found(hashes: Column) -> Column:
        parts = [F.transform(F.filter(_fingerprints(hashes, n, window), lambda r: _may_hold(bitmap, bits, _value(r))), around(n)) for n in lengths]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    grams = _bound(F.transform(words, lambda w: F.xxhash64(_lower(w))), found)
    return with_words.select("_doc", "_key", F.size("_words").cast("long").alias("_n_words"), grams.alias("_grams"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Rows of ``docs`` (``doc_id, text``) with ``n_words, n_hit, n_items, items, items_sha256, contaminated``.

    A window is ``window`` adjacent words of an item, or all words of a shorter one. A word
    of a document that lies in any occurrence of a window is hit.

    Winnowing: of the ``window`` - 4 adjacent five-word grams inside a window the one with the
    smallest hash is its fingerprint (the leftmost of equal hashes), in items and in documents
    alike, so a shared window has a shared fingerprint. Grams of documents are tested against a
    bitmap of the items' fingerprints of bounded size, joined with the fingerprints, and extended to
    the windows around them, which are compared word by word. Items shorter than a window are one
    gram of their own length. Both joins have one row for a key on the items' side, so passages that
    a third of all documents share stay one row for each document.

    One pass reads the texts; only the grams that pass the bitmap leave it. Equal texts are decided once.

    * A null or empty text has no words and no hits; an item without words has no window.
    * Rows of ``items`` with one id are one item; a null id counts as the id ''.
    * Documents with one id, and repeated rows, each get a row; null ids stay.
    * No items or no documents: no hits, or no rows. Other columns of both tables are not read.
    * ``items`` lists the ids as strings in code-point order; ``items_sha256`` is the hash of
      their comma-joined list, of the empty text where there are none.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    listed = stored(_windows(items, window))
    distinct = stored(listed.select("words").distinct().select("words", F.size("words").alias("length"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")))
    lengths = sorted(r["length"] for r in distinct.select("length").distinct().collect())
    keyed = docs.select(F.col("doc_id").alias("_doc"), F.md5(F.coalesce("text", F.lit(""))).alias("_key"), F.col("text").alias("_text"))
    none = F.lit(0).cast("long")
    if not lengths:
        plain = keyed.select(F.col("_doc").alias("doc_id"), F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
        ids = F.array().cast("array<string>")
        return plain.select("doc_id", "n_words", none.alias("n_hit"), none.alias("n_items"), ids.alias("items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    own = [F.when(F.col("length") == n, F.transform(_fingerprints(F.col("hashes"), n, window), _value)) for n in lengths]
    values = stored(distinct.select(F.explode(F.coalesce(*own)).alias("value")).distinct())
    bitmap, bits = _filter_bits(values)
    marked = stored(_marked(keyed, bitmap, bits, lengths, window))

    grams = marked.select("_key", F.explode("_grams").alias("g")).select("_key", "g.*").distinct().join(values, "value", "left_semi")
    # A fingerprint at ``place`` lies in the windows that begin up to its reach before it.
    places = F.when(F.col("length") == window, F.sequence(F.col("first"), F.least("place", F.col("first") + F.size("around") - window))).otherwise(F.array("place"))
    complete = (F.col("length") < window) | (F.size("around") >= window)
    spread = grams.filter(complete).withColumn("start", F.explode(places)).select("_key", "start", F.slice("around", F.col("start") - F.col("first") + 1, F.col("length")).alias("words"))
    hits = stored(spread.distinct().join(distinct.select("words"), "words", "left_semi"))

    before = Window.partitionBy("_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("_key", "start").agg(F.max(F.size("words")).alias("length")).withColumn("end", F.col("start") + F.col("length"))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.select("_key", fresh.alias("fresh")).groupBy("_key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    owners = hits.select("_key", "words").distinct().join(listed, "words").select("_key", "item").distinct()
    named = owners.groupBy("_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    decided = stored(covered.join(named, "_key"))

    ids = F.coalesce("items", F.array().cast("array<string>"))
    out = marked.select("_doc", "_key", "_n_words").join(decided, "_key", "left")
    return out.select(
        F.col("_doc").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.coalesce("n_hit", none).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
