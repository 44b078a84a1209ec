"""SimHash fingerprints and near-duplicate groups over sharded BK-trees."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .hamming import fingerprint_links
from .shared import WORD_HASHES, gram_hashes, keep_only, keep_words, lower_words_of, mixed, scratch, word_hashes

_AT_ONCE = 65_536  # hashes whose bits are counted at a time
SKETCH = 64
#: A pair of Jaccard similarity 0.8 shares none of BANDS bands of BAND_ROWS least hashes with probability
#: (1 - 0.8^4)^24 = 3e-6, and more alike pairs with less; the bands are the same at every corpus size.
BANDS, BAND_ROWS = 24, 4
FUNCTIONS = 128  # of these the first SKETCH give the sketch, the first BANDS * BAND_ROWS the bands, all one bit each
OWNERS = 8  # a shingle of at most so many texts is rare; each set of owners gives 28 pairs at most, and no value changes a result
IDS_SENT = 2_000_000  # ids of texts that are broadcast, about 50 MB; beyond it whole texts are shuffled
_MULTIPLIERS = mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND_FACTORS = mixed(np.arange(1001, 1001 + BAND_ROWS, dtype=np.uint64)) | np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes: zero."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + _AT_ONCE], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes), bitorder="little").tobytes(), "little")


def shingle_fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """SimHash of the XXH64 of all k-word shingles of the lower-cased text, repeats included."""
    words = lower_words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(k, len(words))
    starts, ends = np.concatenate([[0], ends[:-k]]).tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp) of each row; no shuffle. Null or empty text: zero."""

    def values(texts: pa.Array) -> pa.Array:
        keep_only()
        return pa.array(np.array([shingle_fingerprint(t, k) for t in texts.to_pylist()], np.uint64).view(np.int64))

    fingerprint = F.arrow_udf(values, "long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"))


def fingerprint_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, k: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    Fingerprints of at most `radius` differing bits link; component_id is the least doc_id reachable. Equal
    texts, ties and repeated rows share a fingerprint and so a component; null ids get the component of
    their fingerprint (null if all its ids are null). Other columns are not read.
    """
    prints = scratch(spark, fingerprints(docs, id_col, text_col, k), "fingerprints")
    distinct = scratch(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = fingerprint_links(spark, distinct.select(F.col("fp").alias("id"), "fp"), radius)
    labels = components(spark, edges)
    grouped = distinct.join(labels, distinct.fp == labels.node, "left").withColumn("label", F.coalesce("component", "fp"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of = grouped.select("fp", "label").join(least, "label").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(of, "fp").select("doc_id", text, "component_id")


# --- near duplicates by word shingles -------------------------------------------------------------------

def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Distinct hashes of the k-word shingles of the lower-cased text, sorted."""
    return np.unique(gram_hashes(WORD_HASHES.of(lower_words_of(text)), k))


def minima(grams: np.ndarray) -> np.ndarray:
    """The least hash under each of FUNCTIONS functions; grams not empty."""
    least = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        part = grams[at : at + 1024]
        least = np.minimum(least, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1))
    return mixed(least)


def sketch(least: np.ndarray) -> bytes:
    """One byte of each of the first SKETCH least hashes."""
    return least[:SKETCH].astype(np.uint8).tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of the band's number and its BAND_ROWS least hashes, for each band."""
    joined = (least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return mixed(joined + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def bits(least: np.ndarray) -> np.ndarray:
    """Two 64-bit words with one bit of each least hash."""
    return np.packbits((least >> np.uint64(40) & np.uint64(1)).astype(bool)).view(np.int64)


def bits_allowed(similarity: float) -> int:
    """Mean and five sigma of the differing bits of a pair of that similarity; at 0.8, 8e-6 of pairs exceed it."""
    p = (1 - similarity) / 2
    return int(FUNCTIONS * p + 5 * (FUNCTIONS * p * (1 - p)) ** 0.5)


_SIGNED = "doc_id long, content string, fp long, sketch binary, grams long, bits0 long, bits1 long, bands array<long>"


def _signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """The SimHash here is over distinct words: a change of one word moves it far less than one over
    shingles. Words without shingles have no bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.string()), ("fp", pa.int64()), ("sketch", pa.binary()), ("grams", pa.int64()), ("bits0", pa.int64()), ("bits1", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        keep_words()
        for batch in batches:
            out = {n: [] for n in schema.names}
            out["doc_id"] = batch.column(0)
            for text in batch.column(1).to_pylist():
                words = lower_words_of(text)
                hashes = word_hashes(words)
                out["content"].append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                fp = majority(np.unique(hashes))
                out["fp"].append(fp - (1 << 64) if fp >> 63 else fp)
                grams = np.unique(gram_hashes(hashes, k))
                least = minima(grams) if len(grams) else np.zeros(FUNCTIONS, np.uint64)
                out["sketch"].append(sketch(least))
                out["grams"].append(len(grams))
                for name, word in zip(("bits0", "bits1"), bits(least).tolist()):
                    out[name].append(word)
                out["bands"].append(bands(least).tolist() if len(grams) else [])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SIGNED)


def owner_sets(texts: DataFrame, k: int, most: int) -> DataFrame:
    """(ids, shingles): how many shingles have exactly these owners among the texts (id, text); only sets of at most `most` ids.

    A shingle that every text has leaves each task in `most` + 1 rows: Spark limits the ranks before the shuffle.
    """

    def hashes(column: pa.Array) -> pa.Array:
        keep_words()
        return pa.array([shingle_set(t, k).view(np.int64) for t in column.to_pylist()], pa.list_(pa.int64()))

    cells = texts.select("id", F.explode(F.arrow_udf(hashes, "array<long>")("text")).alias("h"))
    first = cells.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("n") <= most + 1)
    owners = first.groupBy("h").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.count("*").alias("c")).where(F.col("c") <= most)
    return owners.groupBy("ids").agg(F.count("*").alias("shingles"))


def rare_shingles(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, rare): how many shingles of a text are in the owner sets; ids with none or with several texts are left out."""
    repeated = texts.groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    return sets.select(F.explode("ids").alias("id"), "shingles").groupBy("id").agg(F.sum("shingles").alias("rare")).join(repeated, "id", "left_anti")


def lone_shingles(texts: DataFrame, k: int) -> DataFrame:
    """(id, alone): how many shingles of a text no other one of the texts (id, text) has; ids with none or with several texts are left out."""
    return rare_shingles(owner_sets(texts, k, 1), texts).withColumnRenamed("rare", "alone")


def _of_ids(source: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) with one of the distinct ids. Up to IDS_SENT of them go to all tasks, so that only texts asked for move."""
    return source.join(F.broadcast(ids) if ids.count() <= IDS_SENT else ids, "id")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (band, label, ...) of bands with several labels, with the band's commonest one, `most`."""
    counts = rows.groupBy("band", "label").agg(F.count("*").alias("m")).groupBy("band").agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.count("*").alias("labels"))
    return rows.join(counts.where("labels > 1").drop("labels"), "band")


def _theirs(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"o_{c}") for c in rows.columns))


def _band_links(spark: SparkSession, nodes: DataFrame, links: DataFrame, similarity: float, source: DataFrame, k: int, checked: Callable) -> DataFrame:
    """Checked links of nodes that share a band or a rare shingle and that the links given do not join.

    Left out are only pairs that cannot be as similar or whose bits say so with five sigma. Two texts of n and
    m shingles are similar only if they share similarity / (1 + similarity) * (n + m). They share what they both
    have of shingles with at most OWNERS owners among the texts of mixed bands, which is counted for each pair
    that has any, and of the others no more than either has. So edits that few copies share keep a loose family from
    being paired. First each node is checked with the node of its band's largest component that has the least
    share of rare shingles; what that joins needs no more pairs. Then a band's largest component is not paired with
    itself, so a large family of copies costs one row for each of its members and each of the others that share a band with it.
    """
    rows = nodes.select("id", F.explode("bands").alias("band"))
    rows = scratch(spark, rows.join(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").drop("n").hint("merge"), "band"), "bands")
    labels = components(spark, links)
    rows = rows.join(labels, rows.id == labels.node, "left").select("band", "id", F.coalesce("component", "id").alias("label"))
    rows = scratch(spark, _mixed(rows), "mixed")
    suspects = rows.select("id", "label").distinct()
    texts = scratch(spark, _of_ids(source, suspects.select("id")), "suspects")
    sets = scratch(spark, owner_sets(texts, k, OWNERS), "owners")
    known = nodes.select("id", "grams", "bits0", "bits1").join(suspects, "id").join(rare_shingles(sets, texts), "id", "left")
    known = scratch(spark, known.withColumn("others", F.col("grams") - F.coalesce("rare", F.lit(0))).drop("rare"), "known")
    rows = scratch(spark, rows.drop("label").join(known.where(F.col("others") >= F.lit(similarity) * F.col("grams") - 1e-6), "id"), "mixed")

    apart = F.bit_count(F.col("bits0").bitwiseXOR(F.col("o_bits0"))) + F.bit_count(F.col("bits1").bitwiseXOR(F.col("o_bits1")))
    alike = (F.least("grams", "o_grams") >= F.lit(similarity) * F.greatest("grams", "o_grams") - 1e-6) & (apart <= bits_allowed(similarity)) & (F.col("label") != F.col("o_label"))

    def enough(rare: Column) -> Column:
        return rare + F.least("others", "o_others") >= F.lit(similarity / (1 + similarity)) * (F.col("grams") + F.col("o_grams")) - 1e-6

    def in_order(pairs: DataFrame, *more: str) -> DataFrame:
        return pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"), *more)

    own = F.struct(F.col("others") / F.col("grams"), *known.columns)
    middle = rows.where("label = most").groupBy("band").agg(F.max(own).alias("x")).select("band", *(F.col(f"x.{c}").alias(f"o_{c}") for c in known.columns))
    star = rows.where("label <> most").join(middle, "band").where(alike & enough(F.lit(0)))
    star = scratch(spark, in_order(star, "label", "o_label").distinct(), "stars")
    found = checked(star.select("a", "b").distinct())
    # a label that a middle's label now is joined to; where that one moves too the two stay apart, which excuses fewer pairs
    moved = scratch(spark, star.join(found, ["a", "b"]).groupBy("label").agg(F.min("o_label").alias("to")), "moved")

    def relabelled(table: DataFrame) -> DataFrame:
        return table.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")

    rows = scratch(spark, _mixed(relabelled(rows.drop("most"))), "mixed")
    known = relabelled(known)
    once = (F.col("label") == F.col("most")) | (F.col("id") < F.col("o_id"))
    pairs = in_order(rows.join(_theirs(rows.where("label <> most").drop("most")), (F.col("band") == F.col("o_band")) & once & alike & enough(F.lit(0))))
    # those with a rare shingle in common, whatever their bands
    two = F.flatten(F.transform("ids", lambda x: F.transform(F.filter("ids", lambda y: y > x), lambda y: F.struct(x.alias("id"), y.alias("o_id")))))
    rare = sets.where(F.size("ids") > 1).select("shingles", F.explode(two).alias("p")).groupBy("p.id", "p.o_id").agg(F.sum("shingles").alias("both"))
    rare = in_order(rare.join(known, "id").join(_theirs(known), "o_id").where(alike & enough(F.col("both"))))
    return found.union(checked(scratch(spark, pairs.union(rare).distinct(), "pairs")))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8,
                    radius: int = 12, guaranteed: int = 5, margin: float = 0.15) -> DataFrame:
    """(doc_id, kept_id) of each document that has a smaller near duplicate; kept_id is its group's least id.

    Equal word sequences (letter case aside) are one document. A link is two documents whose Jaccard
    similarity of the k-word shingle sets is at least `similarity`, checked on the texts. First the heaviest
    spanning forest of those whose SimHash lies within `radius` in a common shard, and whose MinHash sketch
    agrees to `similarity - margin`, is checked; that joins most copies with few checks. Then every pair
    that shares a MinHash band and that checked links have not joined is checked, so what the SimHash, the
    forest or a cut shard left out is found there, at every size with the same probability (see BANDS). Only
    checked links excuse a pair.
    """
    signed = scratch(spark, _signatures(docs, id_col, text_col, k).where("doc_id is not null"), "signatures")
    items = scratch(spark, signed.groupBy("content").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("fp", "sketch", "grams", "bits0", "bits1", "bands"))), "items")
    # one id may stand for several contents if ids repeat; it stays one node
    nodes = items if items.groupBy("id").count().where("count > 1").isEmpty() else scratch(spark, items.dropDuplicates(["id"]), "nodes")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def similarities(left: pa.Array, right: pa.Array) -> pa.Array:
        keep_words()

        def one(x, y):
            x, y = shingle_set(x, k), shingle_set(y, k)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0

        return pa.array([one(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    jaccard = F.arrow_udf(similarities, "double")

    def checked(edges: DataFrame) -> DataFrame:
        named = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
        texts = scratch(spark, _of_ids(source, named).dropDuplicates(["id"]), "texts")
        left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        # pairs are few bytes but much work: adaptive execution would put them into one task
        edges = edges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b")
        return scratch(spark, edges.join(left, "a").join(right, "b").where(jaccard("ta", "tb") >= similarity).select("a", "b"), "checked")

    near = fingerprint_links(spark, nodes.select("id", "fp", "sketch"), radius, guaranteed, similarity - margin, search_again=False)
    # several shards name the same pair
    links = checked(scratch(spark, near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates"))
    links = links.union(_band_links(spark, nodes, links, similarity, source, k, checked))
    copies = signed.join(items.select("content", "id"), "content").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    groups = components(spark, links.union(copies))
    return groups.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_id"))
