"""MinHash near-deduplication with SuperMinHash signatures.

SuperMinHash gives every element one pseudo-random permutation of the slots and adds the step's number to each random
value, so the slots' ranks are correlated and the signature has a lower variance than independent hashes. A document's
steps end once every slot is below the next step's least value; for long documents that is after one or two steps.

1. One pass over the texts makes each document's shingle-set size, a 128-bit digest of the set, the band hashes and the
   signature in 8-bit form. Documents with equal sets are one class, of which only the first takes part in the search.
2. Documents that share a band bucket are candidates. Each bucket has a pivot, its member with the most co-members. Each
   document is verified against the pivot that its signature likens most; links give components.
3. Buckets that still hold several components are searched in full: blocks of bounded size are paired, and members of
   different components whose signatures differ by no more than chance allows are compared by their least hashes, which
   are whole sets up to SAMPLE shingles; pairs that these can't rule out are verified, and components are final.
   Only documents that are already connected are never compared again, so no link is lost. Members of the pivot's component,
   most of a large bucket, are dealt once for each block of the other members and never against each other.

Verification compares full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import WordHashes, drop_table, materialize, mix64, raw_texts, shingle_hashes, small_batches, words_of
from terrane.llm.components import connected_components

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Signatures of documents with similarity s agree in a share s of the slots with a deviation of at most
#: sqrt(s (1 - s) / SLOTS); candidates fewer than DEVIATIONS below the threshold are verified.
DEVIATIONS = 5.0
#: Least hashes of a set that tell sure misses from likely links before sets are compared in full.
SAMPLE = 512
#: Members of one bucket that a task compares with each other, or with as many others, at once.
TILE = 150


def superminhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs x slots) of sets given as distinct 64-bit ``elements`` of document ``owner``.

    Step j gives an element the next slot of its own permutation and the value j + r, with r uniform; a slot keeps its
    least value. All elements take a step together; documents leave once no later step can lower a slot. Slots of an
    empty set stay infinite.
    """
    sig = np.full(n_docs * slots, np.inf)
    seed, perm = elements, None
    for j in range(slots):
        if not len(seed):
            break
        bits = mix64(seed + np.uint64((j * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        r = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mix64(bits ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.int64) * (slots - j) // (1 << 32)
        if j == 0:
            slot = k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(seed), 1))
                np.put_along_axis(perm, first[:, None], perm[:, :1], 1)
            here = np.arange(len(seed))
            slot = perm[here, k].astype(np.int64)
            perm[here, k] = perm[:, j]
        np.minimum.at(sig, owner * slots + slot, j + r)
        going = sig.reshape(n_docs, slots).max(1)[owner] > j + 1
        seed, owner = seed[going], owner[going]
        if perm is not None:
            perm = perm[going]
        elif j == 0:
            first = k[going]
    return sig.reshape(n_docs, slots)


def shingle_sets(raws: list[bytes], size: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for raw in raws:
        w = words_of(raw)
        out.append(np.unique(shingle_hashes(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), size)))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands, sig) of each row of (doc_id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            sets = shingle_sets(raw_texts(batch.column("text")), size, hashes)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), n)
            sig = superminhash(flat, owner, len(sets))
            bits = mix64(sig.view(np.uint64))
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + bits[:, k::ROWS])
            bands += np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
            digest = []
            for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):  # a set's digest: the sum of its mixed elements
                m = np.concatenate(([np.uint64(0)], np.cumsum(mix64(flat ^ np.uint64(salt)), dtype=np.uint64)))
                end = np.cumsum(n)
                digest.append(mix64(m[end] - m[end - n] + n.astype(np.uint64)))
            small = np.where(np.isfinite(sig), bits >> np.uint64(56), 0).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32)), _signed(bands.ravel()))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), _signed(digest[0]), _signed(digest[1]), lists, pa.array([x.tobytes() for x in small], pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, hashes) with the sorted shingle hashes of each row of (doc_id, text) as bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            sets = shingle_sets(raw_texts(batch.column("text")), size, hashes)
            yield pa.record_batch([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "hashes"])

    return docs.mapInArrow(run, "doc_id long, hashes binary")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, name: str, rows: int) -> DataFrame:
    """The at most ``rows`` pairs (a, b) of document ids whose full sets have 100 * intersection >= percent * union."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids", 2 * rows)
    sets = materialize(_sets(docs.join(ids, "doc_id", "left_semi"), size), f"{name}-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = (len(x) + len(y)) // 8
                union = len(np.unique(np.frombuffer(x + y, np.uint64)))
                keep.append(100 * (both - union) >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"{name}-links")
    drop_table(ids)
    drop_table(sets)
    return links


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots in which each row of ``x`` agrees with each row of ``y``."""
    out = np.zeros((len(x), len(y)), np.int16)
    for k in range(x.shape[1]):
        out += x[:, k, None] == y[None, :, k]
    return out


def _least_agreement(percent: int) -> int:
    s = percent / 100
    return int(np.floor(SLOTS * (s - DEVIATIONS * np.sqrt(s * (1 - s) / SLOTS))))


def _samples(docs: DataFrame, size: int) -> DataFrame:
    """(doc, least) with the SAMPLE least shingle hashes, their upper 32 bits, of each row of (doc_id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            sets = shingle_sets(raw_texts(batch.column("text")), size, hashes)
            yield pa.record_batch([batch.column("doc_id"), pa.array([(s[:SAMPLE] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary())], names=["doc", "least"])

    return docs.mapInArrow(run, "doc long, least binary")


def _may_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """False if the least hashes of two sets rule out their link, but for chance beyond DEVIATIONS."""
    both = np.sort(np.concatenate((x, y)))
    twice = both[1:] == both[:-1]
    common, union = int(twice.sum()), len(both) - int(twice.sum())
    if len(x) < SAMPLE and len(y) < SAMPLE:  # whole sets, but for rare hashes that agree in 32 bits
        return 100 * (common + 1) >= percent * (union - 1)
    known = min(union, SAMPLE)
    distinct = both[np.concatenate(([True], ~twice))]
    common = int((both[1:][twice] <= distinct[known - 1]).sum())
    s = percent / 100
    return common / known >= s - DEVIATIONS * np.sqrt(s * (1 - s) / known)


TILE_KEYS = ["key", "inner", "i", "j"]


def _tile_pairs(rows: dict[str, np.ndarray], least_of: list[bytes], at: slice, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs across components of one tile, the rows ``at``, that are worth verifying. An ``inner`` tile pairs the blocks i and j of
    a bucket's outsiders with each other, another tile the outsiders' block i with block j of the pivot's component. Each pair is
    taken in the first band that it shares."""
    tile = {c: v[at] for c, v in rows.items()}
    inner, i, j = bool(tile["inner"][0]), int(tile["i"][0]), int(tile["j"][0])
    doc, comp, n, sig, bands = (tile[c] for c in ("doc", "comp", "n_shingles", "sig", "bands"))
    xs, ys = (np.flatnonzero(tile["part"] == i), np.flatnonzero(tile["part"] == j)) if inner else (np.flatnonzero(tile["out"]), np.flatnonzero(~tile["out"]))
    found: list[tuple[int, int]] = []
    for start in range(0, len(xs), 128):
        x = xs[start : start + 128]
        near = comp[x][:, None] != comp[ys][None, :]
        near &= 100 * np.minimum(n[x][:, None], n[ys][None, :]) >= percent * np.maximum(n[x][:, None], n[ys][None, :])
        if inner and i == j:
            near &= doc[x][:, None] < doc[ys][None, :]
        if not near.any():
            continue
        near &= _agreement(sig[x], sig[ys]) >= least
        a, b = np.nonzero(near)
        a, b = x[a], ys[b]
        first = (bands[a] == bands[b]).argmax(1) == tile["band"][0]
        for u, v in zip(a[first].tolist(), b[first].tolist(), strict=True):
            if _may_link(*(np.frombuffer(least_of[at.start + k], "<u4") for k in (u, v)), percent):
                found.append((min(doc[u], doc[v]), max(doc[u], doc[v])))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _compare_tiles(dealt: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b) of all tiles. Rows are dealt and sorted by tile, and tiles are cut out of the stream of batches, as most hold a few
    rows only; a tile has at most 2 * TILE members, give or take the chance of the hash that deals them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in it:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            edges = edges_of(now)
            if len(edges) > 1:  # the last tile may go on in the next batch
                yield compared(now.slice(0, edges[-1]), edges)
                now = now.slice(edges[-1])
            rest = now
        if rest is not None and rest.num_rows:
            yield compared(rest, [0, rest.num_rows])

    def edges_of(rows: pa.Table) -> list[int]:
        if not rows.num_rows:
            return [0]
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in TILE_KEYS:
            v = rows.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new).tolist()

    def compared(table: pa.Table, edges: list[int]) -> pa.RecordBatch:
        rows = {c: table.column(c).to_numpy() for c in ("doc", "comp", "n_shingles", "part", "out", "band", "inner", "i", "j")}
        rows["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
        rows["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        least_of = table.column("least").to_pylist()
        stops = [*edges[1:], table.num_rows] if edges[-1] != table.num_rows else edges[1:]
        pairs = [_tile_pairs(rows, least_of, slice(lo, hi), least, percent) for lo, hi in zip(edges, stops, strict=False) if hi - lo > 1]
        a, b = (np.concatenate(x) if pairs else np.empty(0, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS).mapInArrow(run, "a long, b long")


def _tiles(members: DataFrame) -> DataFrame:
    """The rows of (key, doc, out, n_in, n_out) for each tile that they belong to: inner, part, i, j. A bucket of M members of
    the pivot's component and m outsiders makes about (2 M + m) * m / TILE rows."""
    ins, outs = F.ceil(F.col("n_in") / TILE).cast("int"), F.ceil(F.col("n_out") / TILE).cast("int")
    part = F.pmod(F.xxhash64("doc"), F.when(F.col("out"), outs).otherwise(ins)).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda inner, i, j: F.struct(F.lit(inner).alias("inner"), i.alias("i"), j.alias("j"))
    mine = F.when(
        F.col("out"),
        F.concat(F.transform(upto(ins), lambda p: tile(False, F.col("part"), p)), F.transform(upto(outs), lambda p: tile(True, F.least("part", p), F.greatest("part", p)))),
    ).otherwise(F.transform(upto(outs), lambda p: tile(False, p, F.col("part"))))
    return members.withColumn("part", part).withColumn("_t", F.explode(mine)).select(*members.columns, "part", "_t.inner", "_t.i", "_t.j")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included), kept.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased; a document's set holds its distinct
    shingles of ``size`` words, or the whole sequence if it is shorter. Links join sets whose similarity is at least
    ``percent`` hundredths.

    Defined cases: a null text, or one without words, has no shingles and is linked with nothing; rows of a null id take no
    part and are kept, with a null component; repeated rows of one id each appear and share their component, and are linked
    by any of the id's texts; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = materialize(sketch(src, size), "minhash-sketch")
    n = sketches.count()
    some = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "minhash-classes", n)

    # the search among the classes' first documents
    reps = some.join(classes.select("d1", "d2", F.col("rep").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi")
    reps = materialize(reps.dropDuplicates(["d1", "d2"]).select(F.col("doc_id").alias("doc"), "n_shingles", "bands", "sig"), "minhash-reps", 4 * n)
    cells = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    shared = materialize(cells.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "minhash-buckets", BANDS // 2 * n)
    members = materialize(cells.join(shared, "key"), "minhash-members", BANDS * n)
    central = materialize(members.groupBy("doc").agg(F.sum("members").alias("central")), "minhash-central", n)
    pivots = members.join(central, "doc").groupBy("key").agg(F.max(F.struct("central", (-F.col("doc")).alias("doc"))).alias("top"))
    pivots = materialize(pivots.select("key", (-F.col("top.doc")).alias("pivot")), "minhash-pivots", BANDS // 2 * n)
    least = _least_agreement(percent)
    pairs = materialize(members.join(pivots, "key").where("doc <> pivot").select("doc", "pivot").distinct(), "minhash-pairs", BANDS * n)
    sigs = reps.select("doc", "n_shingles", "sig")
    with_sigs = pairs.join(sigs, "doc").join(sigs.select(F.col("doc").alias("pivot"), F.col("n_shingles").alias("m"), F.col("sig").alias("other")), "pivot")
    likely = with_sigs.where(f"100 * least(n_shingles, m) >= {percent} * greatest(n_shingles, m)").mapInArrow(_likely(least), "a long, b long, agree int")
    best = likely.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("top"))
    tried = materialize(best.select(F.col("a"), (-F.col("top.b")).alias("b")), "minhash-tried", n)
    texts = src.where("doc_id IS NOT NULL")
    links = _verified(tried, texts, size, percent, "minhash-pivot", n)
    found = connected_components(_with_repeats(links, some, classes), name="minhash-first", rows=2 * n)

    # what buckets of several components still hide
    placed = members.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "band", "doc", F.coalesce("component", "doc").alias("comp"))
    tops = pivots.join(found.withColumnRenamed("node", "pivot"), "pivot", "left").select("key", F.coalesce("component", "pivot").alias("top"))
    placed = materialize(placed.join(tops, "key").select("key", "band", "doc", "comp", (F.col("comp") != F.col("top")).alias("out")), "minhash-placed")
    mixed = placed.groupBy("key").agg(F.count_if("out").alias("n_out"), F.count_if(~F.col("out")).alias("n_in")).where("n_out > 0")
    open_ = materialize(placed.join(materialize(mixed, "minhash-mixed"), "key"), "minhash-open")
    ids = open_.select(F.col("doc").alias("doc_id")).distinct()
    samples = materialize(_samples(texts.join(materialize(ids, "minhash-open-ids"), "doc_id", "left_semi"), size), "minhash-samples")
    dealt = _tiles(open_).join(reps, "doc").join(samples, "doc")
    dealt = dealt.select("key", "band", "doc", "comp", "n_shingles", "bands", "sig", "least", "part", "out", "inner", "i", "j")
    more = materialize(_compare_tiles(dealt, least, percent), "minhash-more")
    late = _verified(more, texts, size, percent, "minhash-late", more.count())
    final = connected_components(late.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), name="minhash-final", rows=2 * n)

    labels = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    labels = materialize(labels, "minhash-labels", n)
    linked: Column = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = sketches.select("doc_id", "n_shingles", "d1", "d2").join(labels, ["d1", "d2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), linked).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_repeats(links: DataFrame, some: DataFrame, classes: DataFrame) -> DataFrame:
    """The links, and those between the classes in which one id stands with several texts."""
    ids = some.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi"), F.count("*").alias("n"))
    repeated = ids.where("lo <> hi").select("doc_id")
    reps = some.join(repeated, "doc_id", "left_semi").join(classes, ["d1", "d2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return links.unionByName(reps)


def _likely(least: int):
    """Pairs whose signatures agree in at least so many slots."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sig", "other"))
            agree = (x == y).sum(1).astype(np.int32)
            out = pa.record_batch([batch.column("doc"), batch.column("pivot"), pa.array(agree)], names=["a", "b", "agree"])
            yield out.filter(pa.array(agree >= least))

    return run


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose component has an earlier one; columns stay as they are."""
    gone = near_duplicates(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone.distinct(), docs["doc_id"] == F.col("__gone"), "left_anti")
