"""Evaluation texts leaking into training text, by a distributed positional inverted index.

One pass over the corpus stores the postings (term, document, position) of every term that
occurs in the evaluation items; other terms cannot take part in a match. List lengths are
counted over these postings. Of every window of ``run`` consecutive item words the rarest
terms are its anchors, and their lists are intersected first, adjusted by offset: an item and
a document are held together only on a diagonal (position minus offset) on which all anchors
of a window meet. Only there the words themselves are compared, and runs of equal ones give
the exact phrase matches.

Terms are words in lower case, a word being an unbroken run of letters and digits, and are
stored as 64-bit hashes; a match needs ``run`` of them in order. Defined cases: null and empty
texts have no terms; an item shorter than ``run`` words cannot leak; windows with a term that
the corpus lacks are left out; repeated documents each count; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import small_enough, stored

#: Consecutive words that make a leak.
RUN = 13
#: Rarest terms of a window whose lists are intersected first.
ANCHORS = 2


def words(text: Column) -> Column:
    """Words of a text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, off and term of every word of the items."""
    return items.select("item_id", F.posexplode(words(F.col("text"))).alias("off", "word")).select("item_id", "off", F.xxhash64("word").alias("term"))


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings of the corpus for all terms that the items hold."""
    vocabulary = terms.select("term").distinct()
    if small_enough(vocabulary.count(), 64):
        vocabulary = F.broadcast(vocabulary)
    every = documents.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word")).select("doc_id", "pos", F.xxhash64("word").alias("term"))
    return stored(every.join(vocabulary, "term", "left_semi"), "postings")


def window_anchors(terms: DataFrame, lists: DataFrame, run: int = RUN, k: int = ANCHORS) -> DataFrame:
    """item_id, win (place of its first word), rank, off and term of the k rarest terms of every window of ``run`` words.

    Windows that hold a term without postings are left out.
    """
    length = lists.groupBy("term").agg(F.count("*").alias("n"))
    rated = terms.join(length, "term", "left")
    w = Window.partitionBy("item_id").orderBy("off").rowsBetween(0, run - 1)
    windows = rated.select(
        "item_id",
        F.col("off").alias("win"),
        F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term")).over(w).alias("words"),
    ).where(F.size("words") == run)
    rare = windows.select("item_id", "win", F.slice(F.array_sort("words"), 1, k).alias("rare")).where(F.col("rare")[0]["n"] > 0)
    return rare.select("item_id", "win", F.posexplode("rare").alias("rank", "a")).select("item_id", "win", "rank", F.col("a.off").alias("off"), F.col("a.term").alias("term"))


def anchors(terms: DataFrame, lists: DataFrame, run: int = RUN, k: int = ANCHORS) -> DataFrame:
    """item_id, off and term of the anchors of all windows, each once."""
    return window_anchors(terms, lists, run, k).select("item_id", "off", "term").distinct()


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, k: int = ANCHORS) -> DataFrame:
    """doc_id, item_id and the longest run of consecutive item words in the document."""
    terms = stored(item_terms(items), "terms")
    lists = postings(documents, terms)
    first = stored(anchors(terms, lists, run, k), "anchors")
    if small_enough(first.count(), 64):
        first = F.broadcast(first)
    diagonals = (
        lists.join(first, "term")
        .groupBy("item_id", "doc_id", (F.col("pos") - F.col("off")).alias("diag"))
        .agg(F.count("*").alias("hits"))
        .where(F.col("hits") >= min(k, run))
        .drop("hits")
    )
    diagonals = stored(diagonals, "diagonals")
    # what is left is compared word by word along the diagonal, in documents that have one
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    near = documents.join(diagonals.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", hashed.alias("dw"))
    asked = items.join(diagonals.select("item_id").distinct(), "item_id", "left_semi").select("item_id", hashed.alias("iw"))
    low = F.greatest(F.col("diag"), F.lit(0))
    off = F.greatest(-F.col("diag"), F.lit(0))
    span = F.least(F.size("dw") - low, F.size("iw") - off)
    same = F.zip_with(F.slice("dw", low + 1, span), F.slice("iw", off + 1, span), lambda x, y: F.when(x == y, F.lit("1")).otherwise(F.lit("0")))
    met = diagonals.join(near, "doc_id").join(asked, "item_id").select("doc_id", "item_id", F.array_join(same, "").alias("met"))
    long = met.where(F.contains("met", F.lit("1" * run)))
    best = F.array_max(F.transform(F.split("met", "0+"), lambda x: F.length(x)))
    return long.select("doc_id", "item_id", best.alias("words")).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def proximity(documents: DataFrame, items: DataFrame, k: int = 3 * ANCHORS, slack: int = 3, run: int = RUN) -> DataFrame:
    """doc_id, item_id where all k rarest terms of a window stand near their order.

    The anchors of a window may each be shifted by up to ``slack`` words against the others,
    so passages with inserted or removed words are found as well. The rarest two are
    intersected first: only where two of them meet near one diagonal an item and a document can
    hold a whole window, and only those postings go on.
    """
    terms = stored(item_terms(items), "terms")
    lists = postings(documents, terms)
    every = stored(window_anchors(terms, lists, run, k), "anchors")
    bounded = lambda df, width: F.broadcast(df) if small_enough(df.count(), width) else df
    rarest = every.where(F.col("rank") < ANCHORS).select("item_id", "off", "term").distinct()
    # diagonals at most slack apart lie in the same cell or in neighbours, so each counts in two
    cell = F.floor(F.col("diag") / (slack + 1))
    in_cells = lambda df: df.withColumn("diag", F.col("pos") - F.col("off")).select("item_id", "doc_id", "off", "diag", F.explode(F.array(cell, cell - 1)).alias("cell"))
    met = in_cells(lists.join(bounded(rarest, 64), "term"))
    met = met.groupBy("item_id", "doc_id", "cell").agg(F.min("off").alias("a"), F.max("off").alias("b"))
    pairs = stored(met.where((F.col("a") < F.col("b")) | F.lit(min(ANCHORS, k) < 2)).select("item_id", "doc_id", "cell"), "pairs")
    # of these, the windows that have both as their rarest
    again = in_cells(lists.join(bounded(rarest, 64), "term")).join(pairs, ["item_id", "doc_id", "cell"], "left_semi")
    owned = again.join(bounded(every.where(F.col("rank") < ANCHORS).select("item_id", "win", "off"), 64), ["item_id", "off"])
    hopeful = owned.groupBy("item_id", "doc_id", "cell", "win").agg(F.min("off").alias("a"), F.max("off").alias("b")).where((F.col("a") < F.col("b")) | F.lit(min(ANCHORS, k) < 2))
    hopeful = stored(hopeful.select("item_id", "doc_id", "win").distinct(), "hopeful")
    wanted = hopeful.join(every.select("item_id", "win", "off", "term"), ["item_id", "win"])
    places = wanted.join(lists, ["doc_id", "term"]).select("item_id", "doc_id", "win", "off", (F.col("pos") - F.col("off")).alias("diag"))
    w = Window.partitionBy("item_id", "doc_id", "win").orderBy("diag").rangeBetween(0, slack)
    return places.withColumn("near", F.size(F.collect_set("off").over(w))).where(F.col("near") >= k).select("doc_id", "item_id").distinct()
