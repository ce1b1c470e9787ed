"""Near-duplicates by SuperMinHash signatures, banding, exact verification and components.

A document's set holds the hashes of its distinct runs of SHINGLE words (the whole sequence, if it has fewer);
a hash of words is 64 bits wide. Every element deals correlated ranks: it visits the SIZE places of the signature
in an order of its own and offers rank + fraction to each. All elements of a document take their j-th step
together, and after step j no later offer can beat a filled place, so the walk stops once every place is filled:
after two or three steps for usual texts. Places agree with probability equal to the Jaccard similarity.

ROWS places make a band key. Documents with equal sets are one class; classes that share a band key are
candidates: in STARS rounds each is verified on the full sets with the class of its band that meets most others and
was not the centre before, where both are not yet in one component; then, for bands whose members are still in
several components, the pairs across components that an exact bound on their overlap, by rare shingles, leaves. Nothing is capped. A pair at similarity
0.75 shares no band with probability (1 - 0.75^5)^51 = 1e-6. The members of a large group meet its centre in parts
of at most PART pairs.

Defined results: words are lower-cased in A-Z only; null and wordless texts have an empty set, no links and
their own component; rows with equal doc_id are one node, whatever their texts, linked by the links of each; a row with
null doc_id has no links and a null component (kept); an empty table gives no rows; texts of any length are read whole;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, FEW, arrow_rows, discard, light, mix, rolling, stored, with_several, word_hashes
from .components import components

SHINGLE = 5
SIZE, BANDS, ROWS = 256, 51, 5
#: Rounds in which each band tests its members against one more of them.
STARS = 3
#: A shingle of at most so many classes is rare.
RARE = 8
#: Pairs of one centre that are verified together.
PART = 500
#: Documents with candidates whose numbers are broadcast to the texts; more are joined by shuffling.
NODES = 2_000_000

_SIGNED = "node long, doc_id long, several boolean, n_shingles long, digest binary, bands array<long>"
GROUPED = "doc_id long, n_shingles long, component_id long, kept boolean"


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(width, len(words))
    return np.unique(rolling(word_hashes(words), n, BASE_A) ^ np.uint64(width - n))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set: rank in the high byte, fraction below."""
    out = np.full(len(sets) * SIZE, np.iinfo(np.uint64).max, np.uint64)
    counts = np.array([len(s) for s in sets])
    elements = mix(np.concatenate([np.empty(0, np.uint64), *sets]) + np.uint64(BASE_B))
    doc = np.repeat(np.arange(len(sets)), counts)
    mask = np.uint64(SIZE - 1)
    for j in range(SIZE):
        if not len(elements):
            break
        step = np.uint64(j)
        # A bijection of the places for each element: affine, xor-shift, odd multiple.
        place = (step * (elements | np.uint64(1)) + (elements >> np.uint64(8))) & mask
        place ^= place >> np.uint64(3)
        place = (place * ((elements >> np.uint64(16)) | np.uint64(1)) + (elements >> np.uint64(24))) & mask
        offer = (step << np.uint64(56)) | (mix(elements + np.uint64(j * BASE_A % (1 << 64))) >> np.uint64(8))
        np.minimum.at(out, doc * SIZE + place.astype(np.int64), offer)
        open_ = (out.reshape(-1, SIZE) >= np.uint64((j + 1) << 56)).any(axis=1)[doc] if j + 1 < SIZE else np.zeros(len(doc), bool)
        elements, doc = elements[open_], doc[open_]
    return out.reshape(-1, SIZE)


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(BASE_A) + parts[:, :, k])
    return key.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in (b.slice(at, 100) for at in range(0, b.num_rows, 100)):
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            keys = band_keys(signatures(sets))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1), pa.int64()))
            same = [part.column(k) for k in ("node", "doc_id", "several")]
            yield pa.RecordBatch.from_arrays([*same, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), bands], names=["node", "doc_id", "several", "n_shingles", "digest", "bands"])


def _verify(batches: Iterator[pa.RecordBatch], numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    last: tuple[int, str, np.ndarray] | None = None
    for b in batches:
        a_out, b_out = [], []
        for a, x, text_a, text_b in zip(*(b.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b"))):
            if last is None or last[0] != a or last[1] != text_a:
                last = (a, text_a, shingle_set(text_a))
            s, t = last[2], shingle_set(text_b)
            common = len(np.intersect1d(s, t, assume_unique=True))
            if denominator * common >= numerator * (len(s) + len(t) - common):
                a_out.append(a)
                b_out.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, numerator: int = 75, denominator: int = 100) -> DataFrame:
    """Of stored pairs(a, b) those whose full sets in texts(node, text) are similar enough; an `a` of many pairs is dealt out."""
    # Pairs of numbers go to the texts where they are few enough; beyond that both are shuffled.
    light = F.broadcast if pairs.count() <= FEW else (lambda df: df)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = pairs.join(sizes.where("parts > 1"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(light(sizes), "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(light(dealt), "b")
    return right.join(left, ["a", "part"]).select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verify(it, numerator, denominator), "a long, b long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in (b.slice(at, 50) for at in range(0, b.num_rows, 50)):
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            tokens = np.concatenate([np.empty(0, np.uint64), *sets]).astype(np.int64)
            rows = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in "bpm"), pa.array(tokens, pa.int64())], names=["b", "p", "m", "token"])


def _across(pool: DataFrame, classes: DataFrame, texts: DataFrame, numerator: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidates (a, b) across components among the classes of pool(band, b, p), p being b's component; near() marks a table of bands for its join.

    A shingle is rare if at most RARE of the classes still in question have it. What two classes have in common is
    the rare shingles that both have, counted in a join on them, and at most as many others as either has. Pairs for which
    this bound is too little for a link are no candidates; those without a rare shingle in common are met by band. So no
    link is lost, and a passage common to thousands makes no pairs of documents that differ.
    """
    kept = pool.groupBy("band").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo != hi")
    left = stored(pool.join(near(kept.select("band")), "band").select("band", "b", "p"), "mixed")
    sizes = classes.select(F.col("rep").alias("b"), F.col("size").alias("m"))
    at_stake = stored(left.groupBy("b").agg(F.first("p").alias("p")).join(sizes, "b"), "at-stake")
    whole = at_stake.join(texts.select(F.col("node").alias("b"), "text"), "b").dropDuplicates(["b"]).select("b", "p", "m", "text")
    tokens = stored(whole.mapInArrow(_tokens, "b long, p long, m long, token long"), "tokens")
    held = F.count(F.lit(1)).over(Window.partitionBy("token"))
    rare = stored(tokens.withColumn("held", held).where(f"held <= {RARE}"), "rare")
    reach = rare.groupBy("b").agg(F.count(F.lit(1)).alias("rare"))
    reach = at_stake.join(reach, "b", "left").withColumn("r", F.col("m") - F.coalesce("rare", F.lit(0))).select("b", "p", "m", "r")
    reach = stored(reach, "reach")

    def pairs(of: DataFrame, on: str) -> DataFrame:
        x, y = (of.select([F.col(c).alias(c if c == on else c + side) for c in of.columns]) for side in "xy")
        return x.join(y, on).where(f"bx < by and px != py and 100 * least(mx, my) >= {numerator} * greatest(mx, my)")

    enough = f"{100 + numerator} * ({{}} + least(rx, ry)) >= {numerator} * (mx + my)"
    sharing = pairs(rare.where("held > 1").select("token", "b", "p", "m"), "token").groupBy(F.col("bx").alias("a"), F.col("by").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    known = [reach.select(F.col("b").alias(of), F.col("m").alias("m" + side), F.col("r").alias("r" + side)) for of, side in (("a", "x"), ("b", "y"))]
    sharing = stored(sharing, "sharing").join(known[0], "a").join(known[1], "b").where(enough.format("shared")).select("a", "b")
    # Classes with so many shingles that aren't rare that they may link without a rare one in common.
    common = reach.where(f"100 * r >= {numerator} * m").join(classes.select(F.col("rep").alias("b"), "bands"), "b").drop("p")
    could = stored(left.join(common, "b"), "common")
    # Each pair comes from the first band that it shares.
    first = "element_at(bandsx, cast(array_position(zip_with(bandsx, bandsy, (v, w) -> v = w), true) as int)) = band"
    many = pairs(could, "band").where(f"{enough.format(0)} and {first}").select(F.col("bx").alias("a"), F.col("by").alias("b"))
    return sharing.union(many).distinct()


def near_duplicates(docs: DataFrame, numerator: int = 75) -> DataFrame:
    """Per document its set's size, its component's least doc_id, and whether it is that document."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, repeated = with_several(rows, "doc_id")
    # A doc_id with several texts has a node for each; they are linked below.
    rows = rows.withColumn("node", F.when(F.col("several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    signed = stored(rows.select("node", "doc_id", "several", "text").mapInArrow(_sign, _SIGNED), "signatures")
    linkable = signed.where("digest is not null and doc_id is not null")
    classes = stored(
        linkable.groupBy("digest").agg(F.min("node").alias("rep"), F.min("doc_id").alias("doc"), F.min_by("bands", "node").alias("bands"), F.first("n_shingles").alias("size")), "classes"
    )
    members = classes.select("rep", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = stored(members.join(sizes, "band"), "bands")
    # A document that meets many others stands near the middle of its group: it is tested first.
    nodes = stored(inside.groupBy("rep").agg(F.sum("n").alias("score")), "nodes")
    # The texts that verification reads: one of each class that meets another, kept by themselves.
    met = nodes.select(F.col("rep").alias("node"))
    texts = stored(rows.select("node", "text").join(F.broadcast(met) if nodes.count() <= NODES else met, "node", "left_semi"), "texts")
    # Few bands are joined by their middles, not by dealing the members by band: a crowded band stays spread.
    bands = inside.agg(F.sum(1 / F.col("n"))).first()[0] or 0
    near = F.broadcast if bands <= FEW else (lambda df: df)
    pool = inside.join(light(nodes), "rep").select("band", F.col("rep").alias("b"), "score", F.col("rep").alias("p"), F.lit(None).cast("struct<score: long, neg: long>").alias("below"))
    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    old = [inside, nodes, texts]
    if repeated:
        own = linkable.where("several").select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
        links = stored(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a != rep").select("a", F.col("rep").alias("b")), "links")
    place = F.struct("score", (-F.col("b")).alias("neg"))
    for _ in range(STARS):
        fresh = F.when(F.col("below").isNull() | (place < F.col("below")), F.struct("score", (-F.col("b")).alias("neg"), "p"))
        middle = pool.groupBy("band").agg(F.max(fresh).alias("c"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo != hi and c is not null").select("band", "c")
        pool = stored(pool.drop("below").join(near(middle), "band").select("band", "b", "score", "p", "c"), "pool")
        if pool.isEmpty():
            break
        pairs = stored(pool.where("p != c.p").select((-F.col("c.neg")).alias("a"), "b").distinct(), "pairs")
        links = stored(links.union(verified(pairs, texts, numerator)), "links")
        old += [pool, pairs, links]
        labels = components(links).select(F.col("id").alias("b"), "component_id")
        pool = pool.join(labels, "b", "left").select("band", "b", "score", F.coalesce("component_id", "b").alias("p"), F.struct("c.score", "c.neg").alias("below"))
    else:
        pairs = stored(_across(pool, classes, texts, numerator, near), "pairs")
        links = stored(links.union(verified(pairs, texts, numerator)), "links")
        old += [pairs, links]
    labels = components(links).withColumnRenamed("id", "rep")
    discard(*old)
    known = classes.join(labels, "rep", "left").select("digest", "doc", F.coalesce("component_id", "rep").alias("component"))
    if repeated:
        # Nodes of repeated doc_ids have other numbers: a component goes by its least doc_id.
        known = stored(known, "known")
        least = known.groupBy("component").agg(F.min("doc").alias("least"))
        known = known.join(least, "component").select("digest", "doc", F.col("least").alias("component"))
    known = known.select("digest", "component")
    plain, wordless = signed.select("doc_id", "several", "n_shingles", "digest").where("digest is not null"), signed.where("digest is null")
    out = plain.join(known, "digest", "left").select("doc_id", "several", "n_shingles", "component")
    out = out.union(wordless.select("doc_id", "several", "n_shingles", F.lit(None).cast("long")))
    if repeated:
        of_doc = out.where("several").groupBy(F.col("doc_id").alias("d")).agg(F.min("component").alias("c"))
        out = out.join(of_doc, F.col("several") & (F.col("doc_id") == F.col("d")), "left").withColumn("component", F.coalesce("component", "c"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
