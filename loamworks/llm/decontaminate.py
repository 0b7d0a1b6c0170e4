"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by size, in powers of two of their distinct five-word
shingles.  An item counts as contained if a document holds at least 0.8 of its
shingles, so it may miss at most 0.2 n of them: of any floor(0.2 u) + 1 of its
shingles, u being the most that its size class allows, the document holds one.
The sketch of an item is therefore its floor(0.2 u) + 1 least shingle hashes;
it grows with the class, and no contained item is lost however long the document
is.  An item of fewer than five words is one shingle of its own length, sought
among the documents' runs of that length.  Documents whose shingles meet a
sketch are candidates, and are then compared with the item's shingles as
strings.  Where the sketches are too large to be broadcast, a filter of fixed
size, one bit for each hash, first drops most of the documents' shingles where
they are made, so that those that meet no sketch aren't shuffled.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Longs of the filter (512 KB): 4 million bits, so a sketch of 400,000 hashes lets 9 of 100 others pass.
FILTER_LONGS = 1 << 16
FILTER_ABOVE = 1 << 16


def words(text: Column) -> Column:
    """Lower-cased words, cut at ASCII white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), lambda w: w != "")


def _runs(found: Column, length: int, shingle) -> Column:
    """An array of ``shingle`` at each start of a run of ``length`` words."""
    n = F.size(found)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), shingle)).otherwise(F.slice(F.transform(F.array(F.lit(0)), shingle), 1, 0))


def shingles(found: Column, length: int) -> Column:
    """The runs of ``length`` words of an array of words, as strings."""
    return _runs(found, length, lambda i: F.array_join(F.slice(found, i + 1, length), " "))


def shingle_hashes(found: Column, length: int) -> Column:
    """The same as 64-bit hashes."""
    return _runs(found, length, lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(length))))


def _of_item(found: Column, each) -> Column:
    """``each`` of the item's shingles: of fewer words than a shingle has, all as one."""
    out = each(found, SHINGLE_WORDS)
    for length in range(1, SHINGLE_WORDS):
        out = F.when(F.size(found) == length, each(found, length)).otherwise(out)
    return out


def _of_document(found: Column, lengths: list[int], each) -> Column:
    return F.concat(*(each(found, n) for n in [SHINGLE_WORDS, *lengths]))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (hash, item): the least hashes of each item, as many as its size class needs."""
    hashed = items.select("item", F.array_sort(F.array_distinct(_of_item(F.col("_words"), shingle_hashes))).alias("h"))
    most = F.pow(F.lit(2), F.ceil(F.log2(F.size("h")))).cast("int")  # of its class
    needed = (F.floor(most * (1 - threshold) + 1e-9) + 1).cast("int")
    return hashed.where(F.size("h") > 0).select(F.explode(F.slice("h", F.lit(1), needed)).alias("hash"), "item")


def _filter(sketch: DataFrame) -> DataFrame:
    """One row (bits): an array of FILTER_LONGS longs with a bit for each hash."""
    at = F.col("hash").bitwiseAND(F.lit(FILTER_LONGS - 1)).alias("id")
    bit = F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(hash, 58) AS int)))").alias("bits")
    every = sketch.sparkSession.range(FILTER_LONGS).join(sketch.groupBy(at).agg(bit), "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "bits")))["bits"].alias("bits"))


def _passes(bits: Column, h: Column) -> Column:
    word = F.get(bits, h.bitwiseAND(F.lit(FILTER_LONGS - 1)).cast("int"))
    return F.call_function("shiftrightunsigned", word, F.shiftrightunsigned(h, 58).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0


def _judged(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """Rows (doc_id, _h, item_id, b) of candidates, _h being the hash of the text that was judged."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_words")).distinct().withColumn("item", F.xxhash64("item_id", "_words"))
    sketch = stored(sketches(items, threshold), "sketches")  # its size is then known: broadcast only if small
    short = [r["n"] for r in items.select(F.size("_words").alias("n")).where(F.col("n").between(1, SHINGLE_WORDS - 1)).distinct().collect()]  # at most four numbers
    worded = docs.select("doc_id", F.xxhash64("text").alias("_hash"), words(F.col("text")).alias("_words"))
    met = worded.select("doc_id", "_hash", F.explode(_of_document(F.col("_words"), sorted(short), shingle_hashes)).alias("hash"))
    if sketch.count() > FILTER_ABOVE:  # the result is the same
        met = met.where(_passes(stored(_filter(sketch), "sketch-filter").scalar(), F.col("hash")))
    pairs = met.join(sketch, "hash").select(F.col("doc_id").alias("_id"), "_hash", "item").distinct()
    candidates = stored(pairs.groupBy("_id", "_hash").agg(F.collect_list("item").alias("_items")), "candidates")
    texts = docs.select("doc_id", F.xxhash64("text").alias("_h"), "text")
    once = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    cut = once.select("doc_id", "_h", "_items", words(F.col("text")).alias("_words"))
    sides = cut.select("doc_id", "_h", "_items", F.array_distinct(_of_document(F.col("_words"), sorted(short), shingles)).alias("_own")).select("doc_id", "_h", "_own", F.explode("_items").alias("item"))
    wanted = items.select("item", "item_id", F.array_distinct(_of_item(F.col("_words"), shingles)).alias("_item"))
    n, found = F.size("_item").cast("long"), F.size(F.array_intersect("_own", "_item")).cast("long")
    return sides.join(wanted, "item").select("doc_id", "_h", "item_id", F.struct((found / n).alias("containment"), found.alias("n_found"), n.alias("n_shingles")).alias("b"))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_found, containment) of documents (doc_id, text) and items (item_id, text).

    A row for each pair whose containment, the share of the item's distinct
    shingles that the document holds, is ``threshold`` or more.  Shingles are
    five lower-cased words; an item of fewer words is one shingle, contained
    where its words stand in a row, and a text of none contains nothing and is
    contained nowhere (null and empty texts).  Of several rows with equal ids, each text is judged by itself and
    the pair is given once, at the highest containment; null ids are values like
    any other.  Texts may be of any length; further columns are ignored; empty
    tables give no rows.
    """
    top = _judged(docs, benchmark, threshold).groupBy("doc_id", "item_id").agg(F.max("b").alias("b")).where(F.col("b.containment") >= threshold)
    return top.select("doc_id", "item_id", "b.n_shingles", "b.n_found", "b.containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no benchmark item; every column and row of the others stays.

    Each row goes by its own text, also where its id is null or that of others.
    """
    found = _judged(docs, benchmark, threshold).where(F.col("b.containment") >= threshold)
    leaks = stored(found.select(F.col("doc_id").alias("_leak"), F.col("_h").alias("_leak_hash")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak"]) & (F.xxhash64(docs["text"]) == leaks["_leak_hash"]), "left_anti")


#: DuckDB SQL for contained_items over the tables documents and benchmark.
SQL = """
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') FROM benchmark
), lengths AS (
  SELECT 5 AS k UNION SELECT len(w) FROM cut WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4
), shingled AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM cut WHERE kind = 'i'
  UNION
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM cut, lengths WHERE kind = 'd' AND len(w) >= k
), sizes AS (SELECT id, count(*) AS n FROM shingled WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(sizes.n) AS n_shingles, count(*) AS n_found, count(*)::DOUBLE / any_value(sizes.n) AS containment
FROM shingled d JOIN shingled i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id
HAVING count(*)::DOUBLE / any_value(sizes.n) >= 0.8
"""
