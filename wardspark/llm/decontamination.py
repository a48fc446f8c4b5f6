"""Exact and near matches of test passages by a distributed positional inverted index.

The index holds a posting (term, document, position) for the terms that a search asks for. A test
item is searched for as its windows; each window from its rarest terms, counted over all documents
first. Their lists are intersected: a posting, shifted by the term's offset, proposes where a
segment of the item (twenty windows) would start, and the proposals for one place of one document are
combined to a bit mask of the terms found. A window whose key terms are all there is then
compared with the document word by word.

Only the postings asked for are shuffled, by document, and stay there: the intersection and the list of matches of a
document need no further shuffle. No key gathers anything: counts are combined per task, and a document's matches are
at most those of its own words. The matches go back to the documents by a join that shuffles
these once. Rows with a null or empty text have no words; a very long text is one row
like any other. Repeated rows each get the same result (a row is found again by id and text). Test
items without words are ignored; items without id mark words but aren't counted as items. Other columns stay inside
``_row``, whatever their names. Empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.common import KEY, ascii_lower, few, row_key, small, whole_row, written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
RAREST = 3
# Windows of a segment; with the words of the last they fit a mask of 64 bits.
SEGMENT = 20


def term_list(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item, seg, at, window, terms, items``: the windows of the distinct items (``item_id,
    text``). ``at`` is the place of a window in its segment, ``items`` the sorted ids, as
    text, of the items with these words."""
    terms = items.select(F.col("item_id").cast("string").alias("item_id"),
                         term_list(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
    distinct = terms.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    last = F.greatest(F.size("terms") - width, F.lit(0))
    starts = distinct.select("terms", "items", F.md5(F.array_join("terms", " ")).alias("item"),
                             F.explode(F.sequence(F.lit(0), last)).alias("s"))
    seg = F.floor(F.col("s") / SEGMENT).cast("int")
    return starts.select(
        "item", seg.alias("seg"), (F.col("s") - seg * SEGMENT).alias("at"),
        F.concat_ws("-", "item", "s").alias("window"),
        F.slice("terms", F.col("s") + 1, F.lit(width)).alias("terms"), "items")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``k1, k2, pos, term``: the places of the given terms (distinct) in the documents, all those of a document in
    one partition; other terms are dropped where the texts are read."""
    rows = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
    places = rows.select(*KEY, F.posexplode(term_list(F.col("text"))).alias("pos", "term"))
    return places.join(small(terms), "term", "left_semi").repartition(*KEY)


def rarest_terms(docs: DataFrame, phrases: DataFrame, rarest: int | None = RAREST) -> DataFrame:
    """``window, term, offset, rank, full``: the terms of each phrase that occur least often in all
    documents (None: all its terms), and how many these are. Phrases with a term that never
    occurs are left out."""
    parts = phrases.select("window", F.posexplode("terms").alias("offset", "term"))
    vocabulary = written(few(parts.select("term").distinct()), "vocabulary")
    counts = (docs.select(F.explode(term_list(F.col("text"))).alias("term"))
              .join(small(vocabulary), "term", "left_semi").groupBy("term").count())
    counted = parts.join(counts, "term", "left")
    order = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "offset")
    ranked = (counted.withColumn("rank", F.row_number().over(order) - 1)
              .withColumn("least", F.min(F.coalesce("count", F.lit(0)))
                          .over(Window.partitionBy("window")))
              .withColumn("n", F.count("*").over(Window.partitionBy("window"))))
    full = F.least(F.col("n"), F.col("n") if rarest is None else F.lit(rarest)).cast("int")
    return (ranked.filter((F.col("least") > 0) & (F.col("rank") < full))
            .select("window", "term", "offset", "rank", full.alias("full")))


def intersect(index: DataFrame, phrases: DataFrame, keys: DataFrame) -> DataFrame:
    """``k1, k2, start, terms, items``: places where all key terms of a window stand at their
    offsets. ``phrases`` are windows, ``keys`` their rarest terms."""
    placed = keys.join(phrases.select("window", "item", "seg", "at"), "window").withColumn(
        "bit", F.col("at") + F.col("offset"))
    need = placed.groupBy("window").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("need"))
    wanted = written(few(phrases.join(need, "window")), "wanted")
    fewest = placed.groupBy("item", "seg").agg(F.min("full").alias("fewest"))
    lists = written(few(placed.select("term", "item", "seg", "bit").distinct()
                        .join(fewest, ["item", "seg"])), "lists")
    proposed = index.join(small(lists), "term").select(
        *KEY, "item", "seg", "fewest", (F.col("pos") - F.col("bit")).alias("base"),
        F.expr("shiftleft(1L, bit)").alias("mask"))
    met = (proposed.groupBy(*KEY, "item", "seg", "base", "fewest")
           .agg(F.bit_or("mask").alias("mask")).filter("bit_count(mask) >= fewest"))
    return (met.join(small(wanted, 20_000), ["item", "seg"])
            .filter("mask & need = need AND base + at >= 0")
            .select(*KEY, (F.col("base") + F.col("at")).alias("start"), "terms", "items"))


def matched(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``_row`` (the whole row of ``docs``), ``n_words`` and ``hits``, a list of
    ``(start, len, items)``, for each document."""
    phrases = written(few(windows(items.select("item_id", "text"), width)), "windows")
    texts = docs.select("doc_id", "text")
    keys = written(few(rarest_terms(texts, phrases)), "keys")
    index = postings(texts, written(few(keys.select("term").distinct()), "key-terms"))
    by_doc = intersect(index, phrases, keys).groupBy(*KEY).agg(
        F.collect_list(F.struct("start", F.col("terms").alias("want"), "items")).alias("found"))
    rows = docs.select(whole_row(docs).alias("_row"), *row_key(docs["doc_id"], docs["text"]))
    joined = rows.join(by_doc, KEY, "left")
    told = joined.select("_row", "found", term_list(F.col("_row.text")).alias("terms"))
    same = F.filter(F.coalesce("found", F.array().cast(by_doc.schema["found"].dataType)),
                    lambda x: F.slice("terms", x["start"] + 1, F.size(x["want"])) == x["want"])
    hits = F.transform(same, lambda x: F.struct(x["start"].alias("start"),
                                                F.size(x["want"]).alias("len"),
                                                x["items"].alias("items")))
    return told.select("_row", F.size("terms").cast("long").alias("n_words"), hits.alias("hits"))


def overlap(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``_row, n_words, n_hit, n_items, items`` for each row of ``docs`` (``doc_id, text``, ...):
    words inside any window of the items (``item_id, text``), and the ids of these items."""
    found = matched(docs, items, width)
    inside = F.array_distinct(F.flatten(F.transform(
        "hits", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    named = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    return (found.select("_row", "n_words", F.size(inside).cast("long").alias("n_hit"),
                         named.alias("items"))
            .withColumn("n_items", F.size("items").cast("long")))


def near_matches(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """``k1, k2, phrase, pos``: places of a phrase's rarest term (``phrase, text``) with each
    other term of the phrase at most ``span`` words away, in any order.

    Lists meet by (document, block of ``span`` words): a place looks into its own block and
    both neighbours, so no pairs of distant places are made.
    """
    wanted = written(phrases.select(F.col("phrase").alias("window"),
                                    F.array_distinct(term_list(F.col("text"))).alias("terms"))
                     .filter(F.size("terms") > 0), "phrases")
    texts = docs.select("doc_id", "text")
    keys = written(few(rarest_terms(texts, wanted, None)), "near-keys")
    index = postings(texts, written(few(keys.select("term").distinct()), "near-terms"))
    at = index.join(small(keys), "term")
    block = F.floor(F.col("pos") / span)
    anchors = (at.filter("rank = 0").select(*KEY, "window", "full", F.col("pos").alias("p"),
                                            F.explode(F.array(block - 1, block, block + 1))
                                            .alias("block")))
    others = at.select(*KEY, "window", "pos", "offset", block.alias("block"))
    met = (anchors.join(others, [*KEY, "window", "block"])
           .filter(F.abs(F.col("pos") - F.col("p")) <= span))
    return (met.groupBy(*KEY, "window", "p")
            .agg(F.size(F.collect_set("offset")).alias("seen"), F.first("full").alias("full"))
            .filter("seen = full").select(*KEY, F.col("window").alias("phrase"),
                                          F.col("p").alias("pos")))
