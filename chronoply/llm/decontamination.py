"""Benchmark decontamination by a positional inverted index, in SQL functions only.

The index is dealt by documents: a row for each distinct training text has the postings of
its terms, a map of term to the list of the term's places. It is made once from a pass over
the texts and stored; equal texts are indexed once, so no group of copies is larger than a
row. Only terms that the test side has are posted, as only they can be met.

A phrase is found by intersecting lists. Its terms are ranked by their counts in the index.
The rarest one gives the candidates: its places moved back by its offset in the phrase. They
are intersected with the list of the next rarest term, moved back by its own offset, and so
on until no candidate is left or all terms stand in place. All lists of a text are in its row,
so only the matches are shuffled. Proximity is answered from the same lists: places of one
term that have a place of another within a distance.

The phrases come in blocks of at most ``BLOCK``, which are broadcast one after another; the
test side's terms are broadcast only while they are at most ``broadcast_terms``, beyond that
the same join shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: What parts words: all of ASCII but digits and letters (of lower case, after folding).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are broadcast at once, and those of one rarest term in a row.
BLOCK, TOGETHER = 50_000, 256


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def windows_of(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, words: every window of ``width`` words; of a shorter item, all its words."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), width).alias("words")).distinct()


def index(texts: DataFrame, terms: DataFrame, *, broadcast_terms: int = 500_000) -> DataFrame:
    """(h, postings) of the rows (h, t) with distinct h that have one of the ``terms``:
    postings maps each of these terms to its places in the text, from 0."""
    wanted = F.broadcast(terms) if terms.count() <= broadcast_terms else terms
    met = texts.select("h", F.posexplode(words_of(F.col("t"))).alias("pos", "term")).join(wanted, "term", "left_semi")
    lists = met.groupBy("h", "term").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    return stored(lists.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("postings")), "postings")


def phrases(lists: DataFrame, wanted: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(p, h, start): each place, from 0, where the whole phrase p of the rows (p, words) stands."""
    frequency = lists.select(F.explode("postings").alias("term", "places")).groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    terms = wanted.select("p", F.posexplode("words").alias("off", "term")).join(frequency, "term", "left")
    # The rarest terms first; a term that the corpus lacks ends its phrase.
    ranked = terms.groupBy("p").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "off"))).alias("terms"))
    rarest = ranked.select("p", F.get("terms", F.lit(0)).alias("first"), F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1))).alias("rest")).where("first.df > 0")
    turn = F.row_number().over(Window.partitionBy("first.term").orderBy("p"))
    rows = rarest.withColumn("part", F.floor(turn / TOGETHER)).groupBy(F.col("first.term").alias("term"), "part")
    asked = stored(rows.agg(F.collect_list(F.struct("p", F.col("first.off").alias("off"), "rest")).alias("asked")), "phrases")

    def moved(places: Column, off: Column) -> Column:
        return F.transform(places, lambda x: x - off)

    def starts(q: Column) -> Column:
        """Of the phrase q, the candidates of its rarest term that all its other terms confirm."""
        none = F.array().cast("array<int>")

        def meet(left: Column, r: Column) -> Column:
            return F.when(F.size(left) == 0, left).otherwise(F.coalesce(F.array_intersect(left, moved(F.try_element_at("postings", r["term"]), r["off"])), none))

        return F.aggregate(q["rest"], moved(F.col("places"), q["off"]), meet)

    found = F.transform("asked", lambda q: F.struct(q["p"].alias("p"), starts(q).alias("starts")))
    blocks = max(1, -(-(asked.agg(F.sum(F.size("asked"))).first()[0] or 0) // block))
    keyed = lists.select("h", "postings", F.explode("postings").alias("term", "places"))
    met = [keyed.join(F.broadcast(asked.where(F.pmod(F.xxhash64("term", "part"), F.lit(blocks)) == k)), "term") for k in range(blocks)]
    # explode_outer: a filter on the empty lists would be pushed down and intersect all of them twice.
    each = [m.select("h", F.explode_outer(F.filter(found, lambda x: F.size(x["starts"]) > 0)).alias("x")) for m in met]
    told = reduce(DataFrame.union, each).where("x is not null")
    return told.select("x.p", "h", F.explode("x.starts").alias("start"))


def near_terms(docs: DataFrame, left: str, right: str, distance: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proximity: id and position of ``left`` where ``right`` stands at most ``distance`` words away.

    Null and empty texts have no words; each of repeated rows has its own places. Other
    columns of ``docs`` may have any names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("t"))
    terms = docs.sparkSession.createDataFrame([(w,) for w in sorted({left, right})], "term string")
    lists = index(base.dropDuplicates(["h"]).select("h", "t"), terms)
    a, b = (F.try_element_at("postings", F.lit(w)) for w in (left, right))
    close = F.filter("a", lambda x: F.exists("b", lambda y: (F.abs(x - y) <= distance) & (x != y)))
    found = lists.select("h", a.alias("a"), b.alias("b")).select("h", F.explode(close).alias("pos"))
    return base.select("id", "h").join(found, "h").select(F.col("id").alias(id_col), "pos")


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", ratio: int = 20, keep_hash: bool = False, **options: int) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs.
    ``keep_hash`` adds text_hash, which tells apart the rows of one id (or of none).

    Null and empty texts have no words. An item without an id is one item of the empty name.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    windows = windows_of(benchmark, width, item_col, item_text)
    named = stored(windows.groupBy("words").agg(F.collect_set(F.coalesce("item_id", F.lit(""))).alias("items")).withColumn("p", F.xxhash64("words")), "windows")
    terms = named.select(F.explode("words").alias("term")).distinct()
    lists = index(base.dropDuplicates(["h"]).select("h", "t"), terms, **options)
    found = phrases(lists, named.select("p", "words")).join(named.select("p", "items", F.size("words").alias("n")), "p")
    spans = found.groupBy("h", "start").agg(F.max(F.col("start") + F.col("n")).alias("stop"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    before = Window.partitionBy("h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    hits = spans.select("h", "items", new.alias("new")).groupBy("h").agg(F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    rows = base.select("id", "h", F.coalesce(F.regexp_count("t", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(hits, "h", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((n_hit > 0) & (ratio * n_hit >= F.col("n_words"))).alias("contaminated"),
        *([F.col("h").alias("text_hash")] if keep_hash else []),
    )
