"""Document fingerprints from closed syncmers over words, as DataFrame expressions only.

A window of K words is an anchor if the smallest hash of its inner substrings (S words) stands at its first or last
place. That depends on the window alone, not on its neighbours, so an edit elsewhere in the text moves no anchor. The
fingerprint is the sorted set of the anchors' 32-bit hashes, over the whole text; likeness is their Jaccard index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.llm.common import shuffle_partitions

K = 5
#: Inner substrings are single words: K of them in a window, and about 2 windows in K are anchors.
S = 1
SPACES = r"[\x20\x09-\x0D]+"
KNOTS = 64


def _word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), lambda w: F.hash(w))


def _is_anchor(h: Column, i: Column) -> Column:
    inner = F.least(*[F.get(h, i + j) for j in range(1, K - S)])
    return F.least(F.get(h, i), F.get(h, i + (K - S))) <= inner


def anchor_positions(h: Column) -> Column:
    """Places (0-based word numbers) of the closed syncmers in an array of word hashes; a text of 1 to K-1 words has one, at 0.

    A text whose windows hold no closed syncmer (mostly texts of K to K+2 words) has all its windows as anchors.
    """
    windows = F.sequence(F.lit(0), F.size(h) - K)
    found = F.filter(F.array(F.filter(windows, lambda i: _is_anchor(h, i)), windows), lambda x: F.size(x) > 0)
    return F.when(F.size(h) >= K, F.get(found, F.lit(0))).when(F.size(h) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def _anchor_hash(h: Column, i: Column) -> Column:
    return F.hash(*[F.get(h, i + j) for j in range(K)])


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<int>, the sorted distinct anchor hashes of the whole text; null and wordless texts give an empty array.

    The sequence of steps is spread over several projections, so that no part is computed twice.
    """
    h, p = f"__h_{out}", f"__p_{out}"
    df = df.withColumn(h, _word_hashes(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(p, anchor_positions(F.col(h)))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.transform(p, lambda i: _anchor_hash(F.col(h), i))))).drop(h, p)


def anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, position, anchor) for positional matching: equal anchors at constant distance mark shared passages."""
    df = docs.select(F.col(doc_id).alias("doc_id"), _word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("__h"))
    df = df.withColumn("position", F.explode(anchor_positions(F.col("__h"))))
    return df.select("doc_id", "position", _anchor_hash(F.col("__h"), F.col("position")).alias("anchor"))


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two fingerprints; two empty ones are alike (1.0)."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def as_string(fp: str) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))))), " ")


def with_next_text(docs: DataFrame, doc_id: str, text: str, carry: list[str], buckets: int) -> DataFrame:
    """Add __next_<c> for each carried column: its value in the next row by descending id (after the last row: the first).

    Rows are dealt to ``buckets`` ranges of ids with about equal counts, in one shuffle; the first row of each range is
    also dealt, as a guest, to the range before it, so each range finds all its successors by itself.
    """
    n, lo, hi, inner = docs.agg(F.count(doc_id), F.min(doc_id), F.max(doc_id), F.percentile_approx(doc_id, [i / KNOTS for i in range(1, KNOTS)], 10_000)).head()
    knots = sorted({lo, hi, *(inner or [])}) if n else [0]
    share = max(1, buckets // max(1, len(knots) - 1))
    if len(knots) == 1:
        bucket = F.lit(0)
    else:
        edges = F.array(*[F.lit(x) for x in knots])
        at = F.greatest(F.lit(1), F.least(F.lit(len(knots) - 1), F.size(F.filter(edges, lambda e: e <= F.col(doc_id)))))
        left, right = F.element_at(edges, at), F.element_at(edges, at + 1)
        inside = F.floor((F.col(doc_id).cast("double") - left) / (right - left) * share).cast("int")
        bucket = (at - 1) * share + F.greatest(F.lit(0), F.least(F.lit(share - 1), inside))
    bucket = F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(bucket).cast("int")  # rows without an id come last
    rows = docs.withColumn("__bucket", bucket)
    firsts = rows.groupBy("__bucket").agg(F.max(doc_id).alias("first")).orderBy(F.desc("__bucket")).collect()  # at most one row for each range
    hosts = [(firsts[i]["first"], firsts[i - 1]["__bucket"]) for i in range(len(firsts))]
    guest_of = docs.sparkSession.createDataFrame(hosts or [(None, 0)], f"__first {docs.schema[doc_id].dataType.simpleString()}, __guest int")
    rows = rows.join(F.broadcast(guest_of), rows[doc_id].eqNullSafe(guest_of["__first"]), "left").drop("__first")
    spots = F.array_compact(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("g")), F.when(F.col("__guest").isNotNull(), F.struct(F.col("__guest").alias("b"), F.lit(True).alias("g")))))
    rows = rows.withColumn("__spot", F.explode(spots)).withColumns({"__b": F.col("__spot.b"), "__g": F.col("__spot.g")}).drop("__spot", "__bucket", "__guest")
    order = W.partitionBy("__b").orderBy("__g", F.col(doc_id).desc_nulls_last(), F.xxhash64(text), text)
    for c in carry:
        rows = rows.withColumn(f"__next_{c}", F.lead(c).over(order))
    return rows.where(~F.col("__g")).drop("__b", "__g")


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses.

    The edited text has its last floor(n/3) code points replaced by as many (or all) from the start of the next document
    by descending id. One row for each row of ``docs``. Null texts count as empty, whose fingerprint is the empty string;
    rows with equal ids follow each other by a hash of their text; rows without an id come last; a single row follows
    itself; an empty table gives no rows. Ids must be numbers or null, as rows are dealt by ranges of them; a text of any
    length is read whole. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = with_fingerprint(rows, "__text", "__fp")
    rows = with_next_text(rows, "doc_id", "__text", ["__text", "__fp"], 4 * shuffle_partitions(docs.sparkSession))
    rows = rows.withColumn("n_chars", F.length("__text").cast("long"))
    m = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.substring(F.col("__text"), F.lit(1), F.col("n_chars").cast("int") - m), F.substring(F.col("__next___text"), F.lit(1), m)))
    rows = rows.drop("__text", "__next___text").withColumn("edited_sha256", F.sha2("__edited", 256))
    rows = with_fingerprint(rows, "__edited", "__efp").drop("__edited")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string("__fp").alias("fingerprint"),
        as_string("__efp").alias("edited_fingerprint"),
        likeness("__fp", "__efp").alias("near_edited"),
        likeness("__fp", "__next___fp").alias("near_next"),
        F.size("__fp").cast("long").alias("n_anchors"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
