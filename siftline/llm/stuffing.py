"""Keyword-stuffed and link-list pages, by rank-frequency curves and divergence from prose.

For every page the words are counted and ranked with SQL windows, and a line is fitted to
log frequency over log rank: slope and residual. Prose of a language is described by its own
words: those that pages labelled with this language use much more often than pages of most
others. Names, products, links, tags and stock keywords occur alike in pages of all languages
and are nobody's prose. The share of a page's words that are prose of some language is held
against the usual share of pages of the same language and comparable length; a page that has
less than ``least`` of it is spam, and one with an extreme slope or residual needs less than
``suspect`` of it; a slope or residual beyond ``alone`` is spam by itself. A page that holds
hardly any prose of a known language can be prose of another one. It is taken for such if it
is built like prose in any language: as many different words as pages of its length have, a
curve that is not extreme, and the short words that join others.

Defined cases: null and empty texts, and texts without a word, are never spam; rows that share
a doc_id are one page; a wrong or missing label moves no page, since its language is the one
whose words it holds most; texts are read whole. With pages of one language only, its words are
specific wherever enough pages hold them, and the rules are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.labels import LANGUAGES, stated
from siftline.llm.leaks import words
from siftline.session import stored

#: Share of a language's pages that must hold a word of its prose. Bounds the word list: a
#: page has few hundred distinct words, so at most that many divided by this share can pass.
MIN_SHARE = 0.02
#: Pages that must hold it in any case, so that one page's own words are not taken for prose.
MIN_PAGES = 5
#: Times that the middle language must be exceeded.
SPECIFIC = 4.0
#: Part of the usual prose share below which a page is spam, alone or with an extreme curve.
LEAST, SUSPECT = 0.53, 0.75
#: Deviations from the usual curve that are extreme.
EXTREME = 4.0
#: Deviations that are spam whatever the words are.
ALONE = 8.0
#: Share of words of two or three letters, and part of the usual share of different words,
#: that prose of any language has.
SHORT, VARIED = 0.2, 0.8


def prose_words(documents: DataFrame, min_share: float = MIN_SHARE, specific: float = SPECIFIC) -> DataFrame:
    """word (64-bit hash) and lang of the words that are specific to a language's pages."""
    known = documents.select(stated(F.col("lang")).alias("lang"), "text").where("lang is not null")
    held = known.select("lang", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).where(~F.col("w").rlike(r"\p{N}"))
    pages = known.groupBy("lang").agg(F.count("*").alias("pages"))
    count = held.groupBy(F.xxhash64("w").alias("word"), "lang").agg(F.count("*").alias("n"))
    share = count.where(F.col("n") >= MIN_PAGES).join(F.broadcast(pages), "lang").groupBy("word").pivot("lang", list(LANGUAGES)).agg(F.sum(F.col("n") / F.col("pages")))
    every = F.array(*[F.coalesce(F.col(k), F.lit(0.0)) for k in LANGUAGES])
    ranked = share.withColumn("s", F.array_sort(every))
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.col(k), F.lit(0.0)).alias("s"), F.lit(k).alias("lang")) for k in LANGUAGES]))
    chosen = ranked.withColumn("best", best).where((F.col("best.s") >= min_share) & (F.col("best.s") >= specific * F.col("s")[len(LANGUAGES) // 2]))
    return chosen.select("word", F.col("best.lang").alias("own"))


def curves(documents: DataFrame, prose: DataFrame) -> DataFrame:
    """One row for each page: words, slope, residual, shares of prose, short and different words, and language.

    The texts are shuffled once, by page; counting, ranking and fitting stay in place.
    """
    pages = documents.select("doc_id", "text").where("text is not null").repartition("doc_id")
    each = pages.select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    counted = each.groupBy("doc_id", F.xxhash64("w").alias("word")).agg(F.count("*").alias("n"), F.max(F.length("w").between(2, 3) & (F.col("w") > ":")).alias("short"))  # digits come before the colon
    known = counted.join(F.broadcast(prose), "word", "left")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "word"))
    ranked = known.select("doc_id", "n", "own", "short", F.log(F.col("n")).alias("y"), F.log(rank).alias("x"))
    own = [F.sum(F.when(F.col("own") == k, F.col("n")).otherwise(0)).alias(k) for k in LANGUAGES]
    fit = ranked.groupBy("doc_id").agg(
        F.sum("n").alias("words"),
        F.count("*").alias("kinds"),
        F.sum(F.when(F.col("short"), F.col("n")).otherwise(0)).alias("short"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
        *own,
    )
    most = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("lang")) for k in LANGUAGES]))
    return fit.select(
        "doc_id",
        "words",
        F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.sqrt(F.greatest((F.col("syy") - F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0))) / F.col("kinds"), F.lit(0.0))).alias("residual"),
        (sum(F.col(k) for k in LANGUAGES) / F.col("words")).alias("prose"),
        (F.col("short") / F.col("words")).alias("short"),
        (F.col("kinds") / F.col("words")).alias("varied"),
        most["lang"].alias("lang"),
        F.floor(F.log2("words")).alias("length"),
    )


def spam_pages(documents: DataFrame, least: float = LEAST, suspect: float = SUSPECT, extreme: float = EXTREME, alone: float = ALONE) -> DataFrame:
    """doc_id and measures of the pages of which most words are no sentences."""
    prose = stored(prose_words(documents), "prose")
    pages = stored(curves(documents, prose), "curves")
    # usual values of a language and length; at most a few hundred rows, however many pages
    usual = pages.groupBy("lang", "length").agg(
        F.percentile_approx("prose", 0.5).alias("usual_prose"),
        F.percentile_approx("slope", 0.5).alias("usual_slope"),
        F.percentile_approx("residual", 0.5).alias("usual_residual"),
        F.percentile_approx("varied", 0.5).alias("usual_varied"),
        F.stddev("slope").alias("sd_slope"),
        F.stddev("residual").alias("sd_residual"),
        F.count("*").alias("n"),
    )
    whole = pages.groupBy("lang").agg(F.percentile_approx("prose", 0.5).alias("lang_prose"))
    every = pages.agg(F.percentile_approx("prose", 0.5).alias("any_prose"))
    held = pages.join(F.broadcast(usual), ["lang", "length"]).join(F.broadcast(whole), "lang").crossJoin(F.broadcast(every))  # one row
    expected = F.when(F.col("n") >= 20, F.greatest("usual_prose", F.col("lang_prose") * 0.9)).otherwise(F.col("lang_prose"))
    # pages without any prose can make up a language of their own; they are held against all
    part = F.try_divide(F.col("prose"), F.when(expected > 0, expected).otherwise(F.col("any_prose")))
    far = F.greatest(
        F.abs(F.try_divide(F.col("slope") - F.col("usual_slope"), F.col("sd_slope"))),
        F.abs(F.try_divide(F.col("residual") - F.col("usual_residual"), F.col("sd_residual"))),
    )
    measured = held.withColumn("part", part).withColumn("far", F.coalesce(far, F.lit(0.0)))
    foreign = (F.col("far") <= extreme) & (F.col("short") >= SHORT) & (F.col("varied") >= VARIED * F.col("usual_varied"))
    return (
        measured.where(((F.col("part") < least) & ~foreign) | ((F.col("part") < suspect) & (F.col("far") > extreme)) | (F.col("far") > alone))
        .select("doc_id", "words", "lang", "slope", "residual", "prose", "part", "far")
    )
