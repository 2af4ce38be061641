"""Document fingerprints: SpotSigs.

A run of common words is an anchor; it and the content words that follow it, common ones skipped, are a signature.  The
set of a text's signatures is its fingerprint; the likeness of two is their Jaccard similarity.  All of it is built
from SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, checkpoint, crc_sql, documents, row_numbers, text_of

#: Words that anchor a signature, and are none of its content.
COMMON = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au avec ce dans de des du en est et la le les ou par pas pour que qui sur un une "
    "auf aus das dem den der die ein eine für im ist mit nicht sich und von zu "
    "al como con del el las lo los no para por se su y"
).split()
#: Content words of a signature.
CHAIN = 3
_MARK = "\x01"
_OTHER = r"[^\p{L}\p{N}]+"


def _branches(words: set[str]) -> str:
    """A pattern of exactly these words that branches at each letter, so that no letter is tried for each word."""
    by = {c: {w[1:] for w in words if w[:1] == c} for c in sorted({w[0] for w in words if w})}
    each = [c + _branches(rest) for c, rest in by.items()]
    if not each:
        return ""
    body = each[0] if len(each) == 1 and "" not in words else f"(?:{'|'.join(each)})"
    return f"{body}?" if "" in words else body


_ANCHOR = rf"(?<= )({_branches(set(COMMON))}) "
_NO_ID = -(1 << 63)


def signatures(text: Column) -> Column:
    """The set of a text's signatures as ascending 32-bit checksums (less 2^31).

    The begin of the text counts as an anchor, so a text with words has at least one; one without words, or null,
    has none.  Case and punctuation don't count.  At the end of the text a chain is shorter.
    """
    plain = F.regexp_replace(F.concat(F.lit(" "), F.lower(text_of(text)), F.lit(" ")), _OTHER, " ")
    marked = F.trim(F.regexp_replace(plain, _ANCHOR, "$1" + _MARK))
    # each content word with the anchors before it, once with a word's neighbours at hand
    whole = F.split(F.concat(F.lit(_MARK), marked), " ")
    both = F.struct(whole.alias("w"), F.transform(whole, lambda x: F.substring_index(x, _MARK, -1)).alias("c"))

    def signature(x: Column, i: Column, content: Column) -> Column:
        rest = [F.get(content, i + k) for k in range(1, CHAIN)]
        sum_ = F.crc32(F.concat_ws(" ", x, *rest).cast("binary"))
        return F.when(F.contains(x, F.lit(_MARK)), (sum_ - (1 << 31)).cast("int"))

    every = F.transform(
        F.array(both), lambda s: F.array_compact(F.transform(s["w"], lambda x, i: signature(x, i, s["c"])))
    )[0]
    return F.when(F.length(marked) > 0, F.sort_array(F.array_distinct(every))).otherwise(F.array().cast("array<int>"))


def fingerprint(sigs: Column) -> Column:
    """Eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h.cast("long") + (1 << 31))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures; 1 for two empty ones."""
    same = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - same
    return F.when(either == 0, 1.0).otherwise(F.round(same / F.greatest(either, F.lit(1)), 9))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: its fingerprint, that of the edited text, and the likenesses to it and to the next.

    The next document has the next smaller id (the largest after the smallest, a null id is the smallest of all); the last half of the
    text is replaced by as much of the next one's begin.  Ids are integers; of rows with equal id the one
    with the smaller hash of its text comes first, and rows equal in both count as one document, each getting its
    result.  Null texts count as empty.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_, text = F.col(id_col).cast("long"), text_of(text_col)
    keyed = docs.select(F.coalesce(id_, F.lit(_NO_ID)).alias("k1"), F.xxhash64(text, F.lit(5)).alias("k2"), text.alias("text"))
    size = F.char_length("text")
    ids = keyed.select("k1", "k2", size.alias("size")).distinct()
    order = checkpoint(row_numbers(ids, [F.col("k1").desc()], "row", [F.col("k2")]))
    many = order.count()
    before = order.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.floor(F.col("size") / 2).cast("int").alias("need"),
                          F.pmod(F.col("row") + 1, F.lit(max(many, 1))).alias("row"))
    before = order.drop("size").join(before, "row").drop("row")
    # both sides read the same columns, so that the texts are shuffled once
    texts = keyed.withColumn("sigs", signatures(F.col("text"))).repartition(n, "k1", "k2")
    nexts = texts.join(before, ["k1", "k2"])
    nexts = nexts.select("p1", "p2", F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("sigs").alias("next"))
    if many < docs.count():
        nexts = nexts.groupBy("p1", "p2").agg(F.first("head").alias("head"), F.first("next").alias("next"))
    both = texts.join(nexts, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
    edited = F.concat(F.substring("text", F.lit(1), (size - F.floor(size / 2)).cast("int")), F.col("head"))
    both = both.select(F.when(F.col("k1") != _NO_ID, F.col("k1")).alias("doc_id"), size.cast("long").alias("n_chars"), "sigs", "next", edited.alias("edited"))
    both = both.withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next")).alias("near_next"),
    )


def similar(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b, likeness)``: pairs of classes of documents with equal fingerprints, named by the smallest id, that are at
    least so alike.  Documents without signatures, null texts too, are in no pair.

    Two sets that are that alike share one of the few rarest signatures of each, and their sizes differ by the
    factor ``least`` at most: the sets are partitioned by size, only neighbouring partitions meet, and only where they
    share such a signature.
    """
    sets = docs.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("sigs")).where("size(sigs) > 0")
    sets = checkpoint(sets.groupBy("sigs").agg(F.min("id").alias("id")))
    every = sets.select("id", F.size("sigs").alias("size"), F.explode("sigs").alias("sig"))
    often = every.groupBy("sig").agg(F.count("*").alias("n"))
    rare = every.join(often, "sig").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("by"))
    prefix = F.col("size") - F.ceil(F.round(F.lit(least) * F.col("size"), 9)) + 1
    band = F.floor(F.log("size") / math.log(1 / least) + 1e-9)
    keys = rare.select("id", "size", band.alias("band"), F.explode(F.slice("by", F.lit(1), prefix.cast("int"))["sig"]).alias("sig"))
    x = keys.select(F.col("id").alias("a"), F.col("size").alias("sa"), "band", "sig")
    y = keys.select(F.col("id").alias("b"), F.col("size").alias("sb"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "sig")
    # a is the smaller one, by size then by id
    smaller = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    pairs = x.join(y, ["band", "sig"]).where(smaller & (F.col("sa") >= F.round(F.lit(least) * F.col("sb"), 9))).select("a", "b").distinct()
    found = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("u")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("v")), "b")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("u"), F.col("v")).alias("likeness"))
    return found.where(F.col("likeness") >= least)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; nulls, empty, long and repeated texts and repeated ids as ``compare_with_next`` says."""
    return compare_with_next(documents(spark, sf_dir))


_COMMON_SQL = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
OP7_SQL = f"""WITH crc AS MATERIALIZED {CRC_TABLE_SQL},
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM d WINDOW o AS (ORDER BY doc_id DESC)),
e AS MATERIALIZED (SELECT doc_id, next_id, text, length(text) AS n_chars, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
plain AS (SELECT doc_id, k, list_filter(string_split(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM (SELECT doc_id, 0 AS k, text AS s FROM e UNION ALL SELECT doc_id, 1, edited FROM e)),
marked AS (SELECT doc_id, k, string_split(chr(1) || rtrim(array_to_string(list_transform(w, lambda x: CASE WHEN list_contains([{_COMMON_SQL}], x) THEN x || chr(1) ELSE x || ' ' END), ''), ' '), ' ') AS w
  FROM plain WHERE len(w) > 0),
content AS (SELECT *, list_transform(w, lambda x: string_split(x, chr(1))[-1]) AS c FROM marked),
chain AS (SELECT DISTINCT doc_id, k, unnest(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: contains(z[1], chr(1))),
  lambda z: array_to_string(list_prepend(z[1], c[z[2] + 1:z[2] + {CHAIN - 1}]), ' '))) AS s FROM content),
summed AS MATERIALIZED (SELECT s, {crc_sql("encode(s)")} AS h FROM (SELECT DISTINCT s FROM chain), crc),
f AS MATERIALIZED (SELECT doc_id, k, list(h ORDER BY h) AS sigs FROM (SELECT DISTINCT doc_id, k, h FROM chain JOIN summed USING (s)) GROUP BY ALL),
g AS (SELECT e.*, coalesce(a.sigs, []) AS x, coalesce(b.sigs, []) AS y, coalesce(z.sigs, []) AS z FROM e LEFT JOIN f a ON a.doc_id = e.doc_id AND a.k = 0
  LEFT JOIN f b ON b.doc_id = e.doc_id AND b.k = 1 LEFT JOIN f z ON z.doc_id = e.next_id AND z.k = 0)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(list_transform(x, lambda h: lpad(lower(to_hex(h)), 8, '0')), '') AS fingerprint,
  array_to_string(list_transform(y, lambda h: lpad(lower(to_hex(h)), 8, '0')), '') AS edited_fingerprint,
  CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE round(len(list_intersect(x, y)) / greatest(len(x) + len(y) - len(list_intersect(x, y)), 1), 9) END::DOUBLE AS near_edited,
  CASE WHEN len(x) + len(z) = 0 THEN 1 ELSE round(len(list_intersect(x, z)) / greatest(len(x) + len(z) - len(list_intersect(x, z)), 1), 9) END::DOUBLE AS near_next
FROM g"""
