"""Near-duplicate documents by b-bit MinHash.

Method: 255 minima of the shingle set give 51 bands of five; the lowest two bits
of each of 512 minima are packed into two bit planes.  Documents that share a
band are candidates.  The number of agreeing b-bit minima, corrected for chance
agreement (Li and Koenig, "b-Bit Minwise Hashing"), estimates the similarity; a
pair within six standard deviations of the limit is then confirmed on the full
sets, so the estimate rejects but never accepts.

Skew: documents of equal sets collapse to one representative before banding.
Of each band bucket, members first meet only the bucket's smallest member, its
hub, and of several hubs first the smallest, then one of each class that a document
does not belong to yet.  Links are closed to classes in between, so most documents
are compared once.  What estimates connect with hubs, however far, is a family.
Members of one family that then lie in different classes meet in cells of bounded
size, the members of its largest class with the others and these among themselves;
cells hold full sets and give nothing but links between classes.  So no pair of a
family is written, though many of its estimates may lie just below the limit.
Pairs of a bucket that belong to different families join on the band key, without
those of the bucket's largest family among themselves.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**5)**51,
below 2e-9.

Defined cases: a null or wordless text has the empty set (n_shingles 0), is
linked with nothing and forms its own class.  A text of fewer words than a
shingle has its whole word sequence as its one shingle.  Equal doc_ids are
one document for classes; each row is returned.  A row whose doc_id is null is
left out of all links (component null, kept true).  Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import GOLDEN, column_of, cut, having, mix, over_texts, pair_hash, release, signed, slices, texts_of, word_names

MINIMA = 512
ROWS = 5
BANDS = 51
_LANES = MINIMA // 64
_XOR = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32)
_ODD = (mix(np.arange(1001, MINIMA + 1001, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle names of each text, sorted within it, and the n + 1 offsets between texts."""
    names, _, _, of = word_names(raw, at, lower=True)
    n = len(of) - 1
    count = np.diff(of)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(n), made)
    place = np.arange(begin[-1]) - begin[doc] + of[:-1][doc]
    left = np.minimum(size, count)[doc]
    out = np.full(len(place), GOLDEN, np.uint64)
    for i in range(size):
        use = left > i
        out[use] = pair_hash(out[use], names[place[use] + i])
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[fresh], np.searchsorted(doc[fresh], np.arange(n + 1))


def _signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and packed low bits (texts x 2 lanes) of texts that all have shingles."""
    small = (sets >> np.uint64(32)).astype(np.uint32)
    least = np.empty((MINIMA, len(at) - 1), np.uint32)
    for i in range(MINIMA):
        x = small ^ _XOR[i]
        x *= _ODD[i]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        least[i] = np.minimum.reduceat(x, at[:-1])
    keys = np.empty((len(at) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        name = np.full(len(at) - 1, b + 1, np.uint64)
        for r in range(ROWS):
            name = pair_hash(name, least[b * ROWS + r].astype(np.uint64))
        keys[:, b] = name
    # the low bits are taken of scrambled minima, as minima themselves are small numbers
    low = mix(np.ascontiguousarray(least.T).astype(np.uint64) + np.uint64(1))
    planes = [np.ascontiguousarray(np.packbits((low >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1)).view(np.uint64) for k in (0, 1)]
    return keys, np.concatenate(planes, axis=1)


def _sketch(size: int):
    def run(batch: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        sets, of = shingle_sets(raw, at, size)
        count = np.diff(of)
        some = np.flatnonzero(count)
        n = len(count)
        hi, lo = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        keys, sigs = np.zeros((n, BANDS), np.uint64), np.zeros((n, 2 * _LANES), np.uint64)
        if len(some):
            starts = of[some]
            hi[some] = mix(np.add.reduceat(mix(sets), starts) + count[some].astype(np.uint64))
            lo[some] = mix(np.add.reduceat(mix(sets ^ GOLDEN), starts))
            keys[some], sigs[some] = _signatures(sets, np.append(starts, len(sets)))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(signed(x).ravel()))
        return pa.record_batch(
            [column_of(batch, "doc_id"), pa.array(count), pa.array(signed(hi)), pa.array(signed(lo)), lists(keys), lists(sigs)],
            names=["doc_id", "n_shingles", "set_hi", "set_lo", "bands", "sig"],
        )

    return run


def _agree(size: int):
    """Of rows with both texts: how many shingles they share, and how many each has."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a"):
                a, at = shingle_sets(*texts_of(column_of(part, "text_a")), size)
                b, bt = shingle_sets(*texts_of(column_of(part, "text_b")), size)
                # a shingle of both stands twice in its row's sorted union
                row = np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(at)), np.repeat(np.arange(part.num_rows), np.diff(bt))])
                name = np.concatenate([a, b])
                order = np.lexsort((name, row))
                name, row = name[order], row[order]
                both = np.bincount(row[1:][(name[1:] == name[:-1]) & (row[1:] == row[:-1])], minlength=part.num_rows)
                yield pa.record_batch([column_of(part, "a"), column_of(part, "b"), *(pa.array(x.astype(np.int64)) for x in (both, np.diff(at), np.diff(bt)))], names=["a", "b", "both", "n_a", "n_b"])

    return run


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures: (agreeing / MINIMA - 1/4) / (3/4)."""
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i]).bitwiseOR(a[i + _LANES].bitwiseXOR(b[i + _LANES]))) for i in range(_LANES)), F.lit(0))
    return ((F.lit(1.0) - differ / F.lit(float(MINIMA))) - 0.25) / 0.75


def least_estimate(percent: int) -> float:
    """Six standard deviations of the estimate below the wanted similarity."""
    agree = 0.25 + 0.75 * percent / 100
    return (agree - 6 * (agree * (1 - agree) / MINIMA) ** 0.5 - 0.25) / 0.75


def _compared(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """a, b, both, n_a, n_b of the pairs (a, b) on their full sets."""
    wanted = cut(pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select("b").distinct()).distinct())
    texts = having(docs, wanted, "doc_id")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(_agree(size), "a long, b long, both long, n_a long, n_b long")


#: Members of a group in a block, of which two make a cell, their shingles, and shingles counted at a time.
CELL, CELL_SHINGLES, COLUMNS = 2000, 2_000_000, 2048
#: Members of a cell that are held against all others of it at a time.
STRIP = 256


def _cell_links(size: int, percent: int):
    """Links between members of different components in one cell, one for each pair of components."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        raw, at = texts_of(column_of(batch, "text"))
        sets, of = shingle_sets(raw, at, size)
        rep, part, block = (column_of(batch, c).to_numpy(zero_copy_only=False) for c in ("rep", "part", "block"))
        n, count = len(rep), np.diff(of)
        row = np.repeat(np.arange(n), count)
        names, column, times = np.unique(sets, return_inverse=True, return_counts=True)
        often = times > 1
        place = np.cumsum(often) - 1
        keep = often[column]
        row, column = row[keep], place[column[keep]]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(often.sum()), COLUMNS):
            a, b = np.searchsorted(column, (start, start + COLUMNS))
            dense = np.zeros((n, COLUMNS), np.float32)
            dense[row[a:b], column[a:b] - start] = 1
            both += dense @ dense.T
        i, j = (int(column_of(batch, c)[0].as_py()) for c in ("i", "j"))
        found = []
        for start in range(0, n, STRIP):
            own = slice(start, start + STRIP)
            linked = 100 * both[own] >= percent * (count[own, None] + count[None, :] - both[own])
            linked &= part[own, None] < part[None, :]
            if i != j:
                linked &= block[own, None] != block[None, :]
            x, y = np.nonzero(linked)
            found.append((x + start, y))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        _, first = np.unique(np.stack([part[x], part[y]], 1), axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
        release()
        return pa.table({"a": rep[x[first]], "b": rep[y[first]]})

    return run


def _largest(members: DataFrame, key: str, of: str) -> DataFrame:
    """key, main: the value of `of` that most rows of each key have, where there are two at least."""
    sizes = members.groupBy(key, of).agg(F.count("*").alias("n"))
    found = sizes.groupBy(key).agg(F.max(F.struct("n", F.col(of).alias("main"))).alias("x"), F.count("*").alias("many")).where("many > 1")
    return cut(found.select(key, "x.main"))


def _within_groups(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links between classes within the groups; members has group, rep, part, n_shingles.

    A task holds two blocks of a group at most, and gives links only.  Blocks hold
    either members of the group's largest class or others; two blocks of the largest
    class never meet.
    """
    members = members.join(_largest(members, "group", "part"), "group").withColumn("outer", F.col("part") != F.col("main"))
    count = lambda outer: F.ceil(F.greatest(F.sum(F.when(F.col("outer") == outer, 1).otherwise(0)) / CELL, F.sum(F.when(F.col("outer") == outer, F.col("n_shingles")).otherwise(0)) / CELL_SHINGLES)).cast("int")
    groups = members.groupBy("group").agg(count(False).alias("inner_blocks"), count(True).alias("outer_blocks"))
    dealt = members.join(groups, "group").withColumn("block", F.when(F.col("outer"), F.col("inner_blocks") + F.pmod(F.xxhash64("rep"), F.col("outer_blocks"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("inner_blocks"))).cast("int"))
    others = F.sequence(F.when(F.col("outer"), F.lit(0)).otherwise(F.col("inner_blocks")), F.col("inner_blocks") + F.col("outer_blocks") - 1)
    dealt = dealt.withColumn("other", F.explode(others))
    cells = cut(dealt.select("group", "rep", "part", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    texts = having(docs, cut(cells.select(F.col("rep").alias("doc_id")).distinct()), "doc_id")
    full = cells.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("group", "rep", "part", "block", "i", "j", "text")
    return full.groupBy("group", "i", "j").applyInArrow(_cell_links(size, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Each row's class of near copies: doc_id, n_shingles, component_id, kept.

    Links join documents with 100 * |intersection| >= percent * |union|.
    component_id is the smallest doc_id that links reach; one row is kept per class.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(over_texts(docs, _sketch(shingle_words), "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sig array<long>"))
    some = rows.where("doc_id is not null and n_shingles > 0")
    # documents of one set share its bands and signature, so any of theirs will do
    lone = cut(some.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("n_shingles")))
    copies = some.select("set_hi", "set_lo", "doc_id").join(lone.where("copies > 1").select("set_hi", "set_lo", "rep"), ["set_hi", "set_lo"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    banded = lone.select(F.explode("bands").alias("key"), "rep")
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    shared = cut(banded.join(hubs, "key"))
    sigs = lone.select("rep", "sig")
    near = estimate(F.col("sa"), F.col("sb")) >= least_estimate(percent)
    linked = F.expr(f"100 * both >= {percent} * (n_a + n_b - both)")
    of_a, of_b = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    # a doc_id that stands in several rows has several sets; its pair with itself means nothing
    met = shared.select(F.col("hub").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    stars = cut(met.join(of_a, "a").join(of_b, "b").where(near).select("a", "b").distinct())
    groups = cut(stars.groupBy("b").agg(F.min("a").alias("group")).select(F.col("b").alias("rep"), "group"))
    links = parts = None
    left = stars
    for turn in range(2):
        if turn == 0:
            now = groups.select(F.col("group").alias("a"), F.col("rep").alias("b"))
        else:
            part = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"p{c}"))  # noqa: B023, E731
            left = cut(left.join(now, ["a", "b"], "left_anti").join(part("a"), "a", "left").join(part("b"), "b", "left").withColumns({c: F.coalesce(c, c[1]) for c in ("pa", "pb")}).where("pa <> pb"))
            if left.isEmpty():
                break
            now = cut(left.groupBy("b", "pa").agg(F.min("a").alias("a")).select("a", "b"))
        made = cut(_compared(now, docs, shingle_words).where(linked).select("a", "b").distinct())
        links = made if links is None else cut(links.union(made))
        parts = components(links)
    # what still lies apart: within a family, that is what estimates connect with hubs, or within a bucket and in different families
    families = cut(components(stars).select(F.col("node").alias("rep"), F.col("component").alias("group")))
    own = lone.select("rep", "n_shingles").join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(families, "rep", "left")
    own = cut(own.select("rep", "n_shingles", F.coalesce("component", "rep").alias("part"), F.coalesce("group", "rep").alias("group")))
    grouped = _within_groups(own.join(families.select("rep"), "rep", "left_semi"), docs, shingle_words, percent)
    parted = shared.where("rep <> hub").select("key", "rep").distinct().join(own.select("rep", "part", "group"), "rep")
    several = parted.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("group").alias("g"), F.max("group").alias("h")).where("p < q and g < h").select("key")
    members = cut(parted.join(several, "key", "left_semi").join(sigs, "rep"))
    outer = members.join(_largest(members, "key", "group"), "key").where(F.col("group") != F.col("main"))
    one = outer.select("key", F.col("rep").alias("a"), F.col("part").alias("pa"), F.col("group").alias("ga"), F.col("sig").alias("sa"))
    two = members.select(F.col("key").alias("key_"), F.col("rep").alias("b"), F.col("part").alias("pb"), F.col("group").alias("gb"), F.col("sig").alias("sb"))
    apart = one.join(two, (F.col("key") == F.col("key_")) & (F.col("pa") != F.col("pb")) & (F.col("ga") != F.col("gb")) & near)
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _compared(cut(apart), docs, shingle_words).where(linked).select("a", "b")
    final = components(links.union(more).union(grouped).union(copies))
    out = rows.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, on shingles of two words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2, percent=80)

