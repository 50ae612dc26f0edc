"""Benchmark decontamination with a distributed positional inverted index.

Test texts become windows of ``n`` consecutive words (a shorter text is one
window).  Collection frequencies of the test terms order each window's terms from
rarest to most frequent; the index stores the postings (term, document, position,
words around) of those terms alone that are among a window's ``probes`` rarest.
A phrase match is the intersection of offset-adjusted postings, rarest terms
first, then the exact comparison with the words stored around the rarest term.  A
proximity match is a stretch of the window's length and ``slop`` more words that holds
all of the window's words in any order; it holds the rarest one, so the words stored
around that one decide.

DataFrame functions only.  Test vocabularies are broadcast when counted and found
below ``BROADCAST_ROWS``; beyond that Spark joins by shuffling.

Defined cases: null and empty texts have no words, zero hits and the digest of an
empty list; items without words or id match nothing; repeated documents each get a
row; repeated items count once per id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronbase.llm.common import ascii_lower, doc_key, materialize, pick

#: Everything that is no word character, once A-Z is lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands behind a document's last word; no word can hold it.
END = "\x00end"
BROADCAST_ROWS = 500_000


def words_of(column: str):
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(column), F.lit(""))), BREAK), "")


def small(df: DataFrame) -> DataFrame:
    """Broadcast below a checked number of rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, n: int) -> DataFrame:
    """``item_id, text`` -> distinct ``window_id, words, item_ids`` of its windows."""
    words = items.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, n))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("window_id", F.md5(F.concat_ws(" ", "words")))


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` stands in ``docs``; terms that never do have no row."""
    return docs.select(F.explode(words_of("text")).alias("term")).join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def probes_of(wins: DataFrame, freq: DataFrame, k: int) -> DataFrame:
    """``window_id, term, off, rank``: each window's ``k`` rarest terms; windows with a term that no document has are dropped."""
    terms = wins.select("window_id", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
    terms = terms.join(freq, "term").withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("window_id"))).where(F.col("found") == F.col("len"))
    once = terms.withColumn("nth", F.row_number().over(Window.partitionBy("window_id", "term").orderBy("off"))).where(F.col("nth") == 1)
    rank = F.row_number().over(Window.partitionBy("window_id").orderBy("cf", "off"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("window_id", "term", "off", "rank")


def index(docs: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """Stored postings ``doc, version, term, pos, lead, context`` of ``terms``, and one of ``END`` per document whose ``pos`` is its length.

    ``context`` holds up to ``around`` words on either side; ``lead`` of them stand before.
    """
    wanted = terms.select("term").distinct().union(docs.sparkSession.createDataFrame([(END,)], "term string"))
    base = docs.select(F.col("doc_id").alias("id"), doc_key().alias("doc"), F.xxhash64("text").alias("version"), F.concat(words_of("text"), F.array(F.lit(END))).alias("words"))
    every = base.select("id", "doc", "version", "words", F.posexplode("words").alias("pos", "term"))
    lead = F.least("pos", F.lit(around))
    context = F.when(F.col("term") != END, F.slice("words", F.col("pos") - lead + 1, lead + around + 1)).alias("context")
    kept = ["id", "doc", "version", "term", "pos", lead.alias("lead")]
    if wanted.count() <= BROADCAST_ROWS:
        found = every.join(F.broadcast(wanted), "term").select(*kept, context)
    else:  # words that are shuffled carry their own surroundings, not the document
        found = every.select(*kept, context).join(wanted, "term")
    return materialize(found, "postings")


def phrases(postings: DataFrame, wins: DataFrame, probes: DataFrame) -> DataFrame:
    """Exact occurrences ``doc, version, start, len, window_id``."""
    at = postings.join(small(probes), "term").withColumn("start", F.col("pos") - F.col("off"))
    bits = F.expr("bit_or(shiftleft(1, rank))")
    need = probes.groupBy("window_id").agg(bits.alias("need"))
    rarest = F.col("rank") == 1
    both = at.groupBy("doc", "version", "window_id", "start").agg(
        bits.alias("have"),
        F.max(F.when(rarest, F.struct(F.col("lead") - F.col("off") + 1, "context"))).alias("near"),
    )
    both = both.join(small(need), "window_id").where((F.col("start") >= 0) & F.col("near").isNotNull() & (F.col("have") == F.col("need")))
    both = both.join(small(wins.select("window_id", "words")), "window_id").where(F.col("near.col1") > 0)
    same = F.slice("near.context", F.col("near.col1"), F.size("words")) == F.col("words")
    return both.where(same).select("doc", "version", "start", F.size("words").alias("len"), "window_id")


def proximity(postings: DataFrame, wins: DataFrame, probes: DataFrame, slop: int) -> DataFrame:
    """``doc, version, window_id`` where all words of the window stand, in any order, within its length and ``slop`` more consecutive words; ``postings`` hold as many words around, less one."""
    at = postings.join(small(probes.where("rank = 1").select("window_id", "term")), "term").join(small(wins.select("window_id", F.col("words").alias("wanted"))), "window_id")
    missing = lambda words: F.size(F.array_except("wanted", words)) > 0
    long = F.size("wanted") + slop
    starts = F.sequence(F.greatest(F.lit(1), F.col("lead") + 2 - long), F.col("lead") + 1)
    within = F.exists(starts, lambda s: ~missing(F.slice("context", s, long)))
    return at.where(~missing(F.col("context"))).where(within).select("doc", "version", "window_id").distinct()


def covered(hits: DataFrame) -> DataFrame:
    """Words of each document that lie inside any occurrence."""
    by_start = Window.partitionBy("doc", "version").orderBy("start", "end")
    spans = hits.select("doc", "version", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    reach = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))
    return spans.withColumn("reach", reach).groupBy("doc", "version").agg(F.sum(new).cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, probes: int = 2, share: float = 0.05, slop: int = 3) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the join keys ``doc, version``.

    ``whole_window`` tells whether a window of all ``n`` words occurs, ``n_near`` counts the items with a proximity match.
    """
    docs = pick(docs, "doc_id", "text")
    items = pick(items, "item_id", "text").where(F.col("item_id").isNotNull())
    wins = materialize(windows(items, n), "windows")
    freq = frequencies(docs, wins.select(F.explode("words").alias("term")).distinct())
    asked = materialize(probes_of(wins, freq, probes), "probes")
    postings = index(docs, asked, n + slop - 1)
    terms = postings.where(F.col("term") != END)
    hits = materialize(phrases(terms, wins, asked), "hits")
    near = proximity(terms, wins, asked, slop).join(small(wins.select("window_id", "item_ids")), "window_id")
    near = near.select("doc", "version", F.explode("item_ids").alias("item")).groupBy("doc", "version").agg(F.count_distinct("item").alias("n_near"))
    whole = hits.groupBy("doc", "version").agg(F.bool_or(F.col("len") >= n).alias("whole_window"))
    by_item = hits.select("doc", "version", "window_id").distinct().join(small(wins.select("window_id", "item_ids")), "window_id")
    by_item = by_item.select("doc", "version", F.explode("item_ids").alias("item")).withColumn("item", F.col("item").cast("string")).distinct()
    by_item = by_item.groupBy("doc", "version").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    found = near.join(covered(hits).join(by_item, ["doc", "version"]).join(whole, ["doc", "version"]), ["doc", "version"], "left")  # whatever is exact is near
    lengths = postings.where(F.col("term") == END).select("id", "doc", "version", F.col("pos").cast("long").alias("n_words"))
    out = lengths.join(found, ["doc", "version"], "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * F.lit(round(1 / share)) >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("whole_window", F.lit(False)).alias("whole_window"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "doc", "version",
    )
