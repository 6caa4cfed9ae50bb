"""Benchmark decontamination over a positional inverted index (operator 11).

Words are runs of letters, digits and code points from U+0080 on, with A-Z
lower-cased.  The index holds one posting (term, document, position) for every
occurrence in the corpus of a term that some item holds (no other term can be
part of a match).  It is written once below ``spark.checkpoint.dir`` and read by
the searches; document frequencies come from it as well.

Phrase search, DataFrame functions only:

1. Items become distinct windows (``WINDOW`` words from every word on, or the
   whole item if shorter).  A window with a term that has no posting is out.
2. Of each window the ``LISTS`` rarest terms are looked up.  Their posting lists
   are moved by the term's place in the window, so that all postings of one
   occurrence carry the same start, and the lists are intersected by grouping on
   (document, window, start).  Rare lists come first, so that the rows grow with
   the occurrences of rare terms and not with those of common words.
3. What is left is compared word by word with the document's text.

Proximity search (``near_matches``) takes the postings of a phrase's rarest term
and looks for all its other terms, in any order, within a span of the phrase's
length plus ``slop`` words around it, through the same index.

Postings of hot terms that no window looks up never move, those of others are
dealt out in parts; no list is gathered.  The candidates of one document meet in one row, as its
words do.  Items of equal words are one class until the last step.

Defined results: null, empty and wordless texts have no words and no hit; rows
of equal id and text give equal rows each; rows of equal id and different texts
are documents of their own; a null id stays null.  Items with equal id are one
item; a null item id counts as the empty string; an item without words never
occurs.  Empty tables give no rows (documents) or no hits (items).  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .suffix_dedup import join_hot

WINDOW = 10
LISTS = 2
#: Fixed: what is a word, after A-Z are lower-cased (the complement of
#: [\x00-\x2F\x3A-\x60\x7B-\x7F]; Java matches the complement of a union of
#: ranges fourteen times slower).
WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["_id", "_h"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORDS), F.lit(0))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the two (the id, and a hash of the text and of
    the id being null): rows of one key are the same document."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return d.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
                    F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("_h"))


def item_words(items: DataFrame) -> DataFrame:
    """item (string), phrase (its words, joined by blanks): items with words."""
    return (items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         F.array_join(words(F.col("text").cast("string")), " ").alias("phrase"))
            .filter("phrase <> ''").distinct())


def windows(phrases: DataFrame, size: int = WINDOW) -> DataFrame:
    """phrase, win: every window of ``size`` words of each distinct phrase, the
    whole phrase if it has fewer."""
    p = phrases.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("w"))
    p = p.select("phrase", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("at"))
    return p.select("phrase", F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("win")).distinct()


def build_index(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """term, _id, _h, pos: postings of the terms of ``phrases`` in all documents
    (``keyed``), written once.  Rows that repeat are counted once or more; the
    searches don't care."""
    terms = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
    tokens = docs.select(*_KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return materialize(tokens.join(terms, "term").select("term", *_KEY, "pos"), "postings")


def frequencies(index: DataFrame) -> DataFrame:
    """term, freq: postings of each term."""
    return materialize(index.groupBy("term").agg(F.count("*").alias("freq")), "frequencies")


def rarest(wins: DataFrame, freq: DataFrame, lists: int) -> DataFrame:
    """wid, term, off, rank, need: the ``lists`` rarest terms of each window by
    postings (ties: by term and place); no row of a window of which a term has
    no posting."""
    each = wins.select("wid", "win").distinct().select(
        "wid", "win", F.posexplode(F.split("win", " ")).alias("off", "term")).join(freq, "term", "left")
    w = Window.partitionBy("wid", "win")
    return (each.withColumn("dead", F.max(F.col("freq").isNull().cast("int")).over(w))
            .withColumn("rank", F.row_number().over(w.orderBy("freq", "term", "off")))
            .withColumn("need", F.least(F.count("*").over(w), F.lit(lists)))
            .filter((F.col("dead") == 0) & (F.col("rank") <= lists)).select("wid", "term", "off", "rank", "need"))


def candidates(index: DataFrame, wins: DataFrame, lists: int = LISTS) -> DataFrame:
    """_id, _h, win, start: where all of a window's rarest terms stand as far
    from each other as in the window."""
    freq = frequencies(index)
    rare = materialize(rarest(wins, freq, lists), "rare-terms")
    wanted = freq.join(rare.select("term").distinct(), "term").select("term", F.col("freq").alias("n"))
    # most postings are of other terms and go before the join that multiplies rows; terms that hold over a
    # thousandth of the postings, so fewer than a thousand, go without a shuffle
    total = freq.agg(F.sum("freq")).first()[0] or 0
    common = freq.filter(F.col("freq") * 1000 > F.lit(total)).join(wanted, "term", "left_anti").select("term")
    lists_of = join_hot(index.join(F.broadcast(common), "term", "left_anti"), wanted, "term", ["_id", "pos"])
    at = lists_of.join(rare, "term").select(
        *_KEY, "wid", (F.col("pos") - F.col("off")).alias("start"), "rank", "need").filter("start >= 0")
    both = at.groupBy(*_KEY, "wid", "start").agg(F.expr("bit_or(1 << (rank - 1))").alias("lists"), F.min("need").alias("need"))
    return both.filter("lists + 1 >= 1 << need").select(*_KEY, "wid", "start").join(wins.select("wid", "win").distinct(), "wid").drop("wid")


def phrase_matches(docs: DataFrame, phrases: DataFrame, index: DataFrame | None = None, size: int = WINDOW,
                   lists: int = LISTS) -> DataFrame:
    """_id, _h, hits (array of start, len, win by start): the documents
    (``keyed``) that hold windows of ``phrases``, with every occurrence."""
    index = build_index(docs, phrases) if index is None else index
    wins = windows(phrases, size).select("win").distinct().withColumn("wid", F.xxhash64("win"))
    found = candidates(index, wins, lists).groupBy(*_KEY).agg(F.collect_set(F.struct(
        "start", (F.length("win") - F.length(F.translate("win", " ", "")) + 1).alias("len"), "win")).alias("c"))
    # the words of a text are made once a document: bound to the name of an outer lambda
    exact = F.transform(F.array(F.struct(words(F.col("text")).alias("w"), F.col("c"))), lambda s: F.filter(
        s["c"], lambda x: F.array_join(F.slice(s["w"], x["start"] + 1, x["len"]), " ") == x["win"]))[0]
    return (docs.select(*_KEY, "text").join(found, _KEY).select(*_KEY, F.sort_array(exact).alias("hits"))
            .filter(F.size("hits") > 0).dropDuplicates(_KEY))


def covered(hits: Column) -> Column:
    """Words inside at least one of the occurrences, which are in order."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        stop = x["start"] + x["len"]
        return F.struct(F.greatest(a["end"], stop).alias("end"),
                        (a["n"] + F.greatest(stop - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"))

    return F.aggregate(hits, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row per
    document."""
    d = keyed(docs)
    it = materialize(item_words(items), "items")
    hits = materialize(phrase_matches(d, it, size=size), "phrase-hits")
    classes = it.groupBy("phrase").agg(F.collect_set("item").alias("ids"))
    seen = (hits.select(*_KEY, F.explode(F.array_distinct(F.transform("hits", lambda x: x["win"]))).alias("win"))
            .join(windows(it, size), "win").select(*_KEY, "phrase").distinct()
            .join(classes, "phrase").groupBy(*_KEY)
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")))
    found = hits.select(*_KEY, covered(F.col("hits")).alias("n_hit")).join(
        seen.select(*_KEY, F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("sha")), _KEY)
    n_words = F.regexp_count(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(WORDS))
    zero = F.lit(0).cast("long")
    return d.select("doc_id", *_KEY, n_words.cast("long").alias("n_words")).join(found, _KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def near_matches(docs: DataFrame, items: DataFrame, slop: int = 5, size: int = WINDOW) -> DataFrame:
    """doc_id, win, near: proximity matches of the items' windows.  A window
    matches where all its distinct terms stand, in any order, within as many
    words as it has plus ``slop``; near is the least such span's length.  One
    row per document and window."""
    d = keyed(docs)
    it = item_words(items)
    index = build_index(d, it)
    wins = windows(it, size).select("win").distinct().withColumn("wid", F.xxhash64("win"))
    reach = size + slop
    n = F.size(F.split("win", " "))
    first = index.join(rarest(wins, frequencies(index), 1).select("wid", "term"), "term").select(*_KEY, "wid", F.col("pos").alias("p0"))
    first = first.distinct().join(wins.select("wid", "win", (n + slop).alias("span")), "wid")
    want = first.select(*_KEY, "win", "p0", "span", F.explode(F.array_distinct(F.split("win", " "))).alias("term"))
    # a posting within a span of p0 lies in p0's block of ``reach`` words or one beside it
    want = want.select("*", F.explode(F.array(*(F.floor(F.col("p0") / reach) + k for k in (-1, 0, 1)))).alias("block"))
    posts = index.distinct().withColumn("block", F.floor(F.col("pos") / reach))
    near = want.join(posts, [*_KEY, "term", "block"]).filter(F.abs(F.col("pos") - F.col("p0")) < F.col("span"))
    # the nearest occurrence of each term on either side of a start decides: least end from each start on
    around = near.groupBy(*_KEY, "win", "p0", "span").agg(F.collect_set(F.struct("pos", "term")).alias("at"))
    terms = F.array_distinct(F.split("win", " "))
    least = F.transform("at", lambda a: F.array_max(F.transform(terms, lambda t: F.array_min(F.transform(
        F.filter("at", lambda b: (b["term"] == t) & (b["pos"] >= a["pos"])), lambda b: b["pos"])))) - a["pos"] + 1)
    complete = F.transform("at", lambda a: F.forall(terms, lambda t: F.exists("at", lambda b: (b["term"] == t) & (b["pos"] >= a["pos"]))))
    best = F.array_min(F.transform(F.filter(F.arrays_zip(least.alias("l"), complete.alias("ok")), lambda z: z["ok"]), lambda z: z["l"]))
    rows = around.select(*_KEY, "win", "span", best.alias("near")).filter("near <= span").groupBy(*_KEY, "win").agg(F.min("near").alias("near"))
    return d.select("doc_id", *_KEY).distinct().join(rows, _KEY).select("doc_id", "win", "near")


#: DuckDB SQL of ``contamination`` over documents and benchmark.
ORACLE = r"""
WITH iw AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, list_slice(w, a, a + 9) AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS a FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT r, a, n, list_slice(w, a, a + n - 1) AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS a
        FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT p.r, p.a, p.n, v.item FROM places p JOIN wins v ON p.win = v.win AND p.n = v.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(a, a + n - 1)) AS p FROM (SELECT DISTINCT r, a, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
