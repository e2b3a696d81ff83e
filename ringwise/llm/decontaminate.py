"""Benchmark decontamination by a distributed positional inverted index.

The training text becomes postings ``(term, document, position)``. Test items are split into
windows of ``size`` consecutive words; each window is looked up by its rarest terms. A posting of
a term at position p, met by the same term at offset q of an item, is offset-adjusted to p - q:
all words of one occurrence share that value, so intersecting the adjusted lists of the rarest
terms leaves a handful of alignments, and only those are compared with the postings of all terms.

What travels: counts of test terms (combined before the shuffle), postings of rare test terms,
and the text of documents that hold an alignment. Postings of frequent words of other documents
never leave the scan, which also tells each document's length. Nothing but test-side tables is broadcast, each behind a
check of its size; where they are too large, the postings of a frequent term are dealt into parts by document. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, materialise, pick, table

#: No word: the posting that every document has, behind those of its words.
TAIL = ""
#: Postings of a term that one part holds at about.
PART_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def postings(keyed: DataFrame) -> DataFrame:
    """``(_key.., term, pos)`` for each word of ``keyed(_id, _h, _text)``, and for ``TAIL`` behind the last one, whose position is their number."""
    return keyed.select("_id", "_h", F.posexplode(F.concat(words(F.col("_text")), F.array(F.lit(TAIL)))).alias("pos", "term"))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows are known by (id, hash of the text), so that repeated ids do no harm."""
    return pick(docs, _id=id_col, _text=text_col).withColumn("_h", F.xxhash64("_text"))


def test_items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(uid, item_id, terms)``; items without words are left out."""
    rows = pick(items, item_id=item_col, _text=text_col).withColumn("terms", words(F.col("_text")))
    return materialise(rows.where(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("uid"), "item_id", "terms"), "items")


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each test term occurs in all documents."""
    seen = docs.select(F.explode(words(F.col("_text"))).alias("term"))
    return seen.join(bounded(vocabulary, 64), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def rarest_terms(items: DataFrame, counts: DataFrame, size: int, anchors: int) -> DataFrame:
    """``(uid, start, need, bit, q)``: for each window of an item, the offsets q of its rarest terms.

    Each has a bit of its own and ``need`` has all of them; a window of fewer than ``anchors`` different words has fewer. A
    window with a term that no document holds is left out, as it can't occur.
    """
    slots = items.select("uid", F.size("terms").alias("n"), F.posexplode("terms").alias("q", "term"))
    rated = slots.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    length = F.least(F.lit(size), F.col("n"))
    placed = rated.select(
        "uid", "q", "term", "df",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - length + 1), F.least(F.col("q"), F.col("n") - length))).alias("start"),
    )
    ranked = placed.groupBy("uid", "start", "term").agg(F.min("q").alias("q"), F.first("df").alias("df")).groupBy("uid", "start").agg(
        F.sort_array(F.collect_list(F.struct("df", "term", "q"))).alias("by_rarity")  # at most `size` words
    )
    possible = ranked.where(F.col("by_rarity")[0]["df"] > 0).withColumn("by_rarity", F.slice("by_rarity", 1, anchors))
    each = possible.select("uid", "start", F.expr("shiftleft(1, size(by_rarity)) - 1").alias("need"), F.posexplode("by_rarity.q").alias("j", "q"))
    return each.select("uid", "start", "need", F.expr("shiftleft(1, j)").alias("bit"), "q")


def alignments(index: DataFrame, items: DataFrame, chosen: DataFrame, rare: DataFrame) -> DataFrame:
    """``(_id, _h, uid, shift)``: where the rarest terms of some window all stand in place."""
    slots = items.select("uid", F.posexplode("terms").alias("q", "term"))
    needed = chosen.select("uid", "q").distinct().join(slots, ["uid", "q"]).join(rare, "term").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    dealt = index.where(F.col("term") != TAIL).withColumn("part", F.pmod(F.xxhash64("_id", "_h"), F.col("parts")))
    met = dealt.join(bounded(needed, 40), ["term", "part"]).select("_id", "_h", "uid", (F.col("pos") - F.col("q")).alias("shift"), "q")
    per_window = met.join(bounded(chosen, 40), ["uid", "q"])
    full = per_window.groupBy("_id", "_h", "uid", "shift", "start").agg(F.bit_or("bit").alias("k"), F.first("need").alias("need")).where("k = need")
    return full.select("_id", "_h", "uid", "shift").distinct()


def occurrences(docs: DataFrame, items: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """``(_id, _h, uid, item_id, shift, start, length)``: each window that occurs, exactly."""
    slots = items.select("uid", F.posexplode("terms").alias("q", "term"))
    expected = found.join(bounded(slots, 80), "uid").select("_id", "_h", "uid", "shift", "q", (F.col("shift") + F.col("q")).alias("pos"), "term")
    holders = bounded(found.select("_id", "_h").distinct(), 40)
    there = postings(docs.join(holders, docs["_id"].eqNullSafe(holders["_id"]) & (docs["_h"] == holders["_h"]), "left_semi"))
    a, b = expected.alias("a"), there.alias("b")
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._h") == F.col("b._h")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.term") == F.col("b.term"))
    runs = a.join(b, same, "left_semi").groupBy("_id", "_h", "uid", "shift").agg(F.sort_array(F.collect_set("q")).alias("qs"))
    sized = runs.join(bounded(items.select("uid", "item_id", F.least(F.lit(size), F.size("terms")).alias("length")), 40), "uid")
    # A window stands at qs[i] where the length-th offset from there is length - 1 further.
    starts = F.expr("filter(transform(qs, (q, i) -> if(i + length <= size(qs) and get(qs, i + length - 1) = q + length - 1, q, null)), q -> q is not null)")
    return sized.select("_id", "_h", "uid", "item_id", "shift", "length", F.explode(starts).alias("start"))


def find_phrases(docs: DataFrame, items: DataFrame, size: int = 13, anchors: int = 3) -> tuple[DataFrame, DataFrame]:
    """Exact matches of every window of ``size`` words of the test items, see ``occurrences``; and ``(_id, _h, n_words)`` of every row of ``docs``."""
    vocabulary = materialise(items.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = materialise(term_counts(docs, vocabulary), "counts")
    chosen = materialise(rarest_terms(items, counts, size, anchors), "anchors")
    slots = items.select("uid", F.posexplode("terms").alias("q", "term"))
    rare = chosen.join(slots, ["uid", "q"]).select("term").distinct().join(counts, "term").select("term", F.ceil(F.col("df") / PART_ROWS).alias("parts"))
    tail = docs.sparkSession.range(1).select(F.lit(TAIL).alias("term"), F.lit(1).cast("bigint").alias("parts"))
    rare = materialise(rare.unionByName(tail), "rare")
    index = materialise(postings(docs).join(bounded(rare, 24), "term"), "postings")
    found = materialise(alignments(index, items, chosen, rare), "alignments")
    return occurrences(docs, items, found, size), index.where(F.col("term") == TAIL).select("_id", "_h", F.col("pos").cast("bigint").alias("n_words"))


def find_near(docs: DataFrame, queries: DataFrame, slop: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Proximity matches: ``(doc, item_id, start)`` where all terms of a query stand within ``slop`` words.

    ``start`` is the position of the query's rarest term. Every other term must have a posting at
    most ``slop`` words away on either side, so lists are met from the rarest term outwards. A
    query without words matches nothing; rows that repeat match as one; empty tables give no match; a text of any length is read
    whole; other columns are not read, whatever they are called.
    """
    texts = keyed_texts(docs, id_col, text_col)
    items = test_items(queries, item_col, "text")
    terms = materialise(items.select("uid", "item_id", F.explode(F.array_distinct("terms")).alias("term")), "query-terms")
    counts = materialise(term_counts(texts, terms.select("term").distinct()), "counts")
    rated = terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    lead = materialise(rated.groupBy("uid", "item_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count(F.lit(1)).alias("n_terms")), "lead-terms")
    index = postings(texts).join(bounded(terms.select("term").distinct(), 64), "term", "left_semi")
    starts = index.join(bounded(lead, 80), "term").select("_id", "_h", "uid", "item_id", "n_terms", F.col("pos").alias("start"))
    around = index.join(bounded(terms.select("uid", "term"), 80), "term").select(F.col("_id").alias("_id2"), "_h", "uid", "term", "pos", F.explode(F.array(*[F.floor(F.col("pos") / (slop + 1)) + d for d in (-1, 0, 1)])).alias("cell"))
    # Positions are met by cells of slop + 1 words: an equi-join, not a range join.
    met = starts.withColumn("cell", F.floor(F.col("start") / (slop + 1))).join(around, ["_h", "uid", "cell"]).where(F.col("_id").eqNullSafe(F.col("_id2")) & (F.abs(F.col("pos") - F.col("start")) <= slop))
    hits = met.groupBy("_id", "_h", "uid", "item_id", "n_terms", "start").agg(F.count_distinct("term").alias("k")).where("k = n_terms")
    return hits.select(F.col("_id").alias(id_col), "item_id", "start").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A document word inside any occurrence of a window of ``size`` item words is hit; an item of
    fewer words is one window. ``contaminated``: some word is hit and 20 * n_hit >= n_words. A
    null text has no words; items without words match nothing; an item without an id counts for
    hits but is not named; rows that repeat get the same result each; empty tables give no hits. A text of any length is
    read whole; other columns are not read, whatever they are called.
    """
    return _verdicts(docs, benchmark, size, id_col, text_col, item_col, item_text).drop("_h")


def _verdicts(docs: DataFrame, benchmark: DataFrame, size: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """The columns of ``decontaminate`` and ``_h``, the hash of the text."""
    texts = keyed_texts(docs, id_col, text_col)
    items = test_items(benchmark, item_col, item_text)
    windows, lengths = find_phrases(texts, items, size)
    windows = materialise(windows, "occurrences")
    first = F.col("shift") + F.col("start")
    per_doc = windows.groupBy("_id", "_h").agg(F.collect_set(F.struct(first.alias("first"), (first + F.col("length")).alias("end"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # Spans in order; each adds the words beyond the furthest end so far.
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], acc["to"]))).cast("bigint").alias("n"), F.greatest(acc["to"], s["end"]).cast("bigint").alias("to")),
        lambda acc: acc["n"],
    )
    hits = materialise(per_doc.select("_id", "_h", covered.alias("hit"), "items"), "hits").alias("h")
    d = lengths.alias("d")
    out = d.join(hits, F.col("d._id").eqNullSafe(F.col("h._id")) & (F.col("d._h") == F.col("h._h")), "left")
    n_hit, names = F.coalesce("h.hit", F.lit(0)).cast("bigint"), F.coalesce("h.items", F.array().cast("array<string>"))
    return out.select(
        F.col("d._id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.col("d._h").alias("_h"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    A null text is clean. Rows are judged by id and text: rows that repeat stay or go together, and a null or repeated id
    takes no other text along. An empty table gives none, an empty benchmark keeps all.
    """
    verdict = _verdicts(docs, benchmark, 13, id_col, text_col, "item_id", "text")
    bad = materialise(verdict.where("contaminated").select(F.col(id_col).alias("_id"), "_h").distinct(), "contaminated")
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    own_id, own_text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    # Ids may repeat with other texts or be missing: the hash of the text tells such rows apart.
    return inner.join(bounded(bad, 24), own_id.eqNullSafe(F.col("_id")) & (F.xxhash64(own_text) == F.col("_h")), "left_anti").toDF(*names)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
with w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as t from documents),
b as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as t from benchmark),
bw as (
  select distinct item_id, least(13, len(t)) as m, array_to_string(t[s : s + least(13, len(t)) - 1], ' ') as g
  from (select item_id, t, unnest(range(1, len(t) - least(13, len(t)) + 2)) as s from b where len(t) > 0)),
sizes as (select distinct m from bw),
dw as (
  select doc_id, s, m, array_to_string(t[s : s + m - 1], ' ') as g
  from (select doc_id, t, m, unnest(range(1, len(t) - m + 2)) as s from w, sizes where len(t) >= m)),
hit as (select distinct doc_id, s, dw.m, item_id from dw join bw on dw.g = bw.g and dw.m = bw.m),
pos as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(s, s + m)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select w.doc_id, cast(len(t) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(t) as contaminated
from w left join pos using (doc_id) left join its using (doc_id)
"""
