"""Near-duplicate documents by one-permutation MinHash with optimal densification, banded buckets and star edges.

Documents with equal shingle sets become one class at once. A class has one signature: its shingles' hashes are dealt
to `bands` x `rows` bins by their upper bits, a bin holds its smallest hash, and an empty bin takes over another one's,
chosen by a hash of the bin and the attempt. Classes that agree in all bins of a band share a bucket. Candidates are
the edges of each bucket's members to the one that has most company in all its buckets (a star), confirmed on full
sets. Only members of buckets that still hold several components then are compared further, by an exact prefix join of
their sets: so no link is lost to the stars, and pairs within a group of copies are never formed.

With 40 bands of 5 rows two sets of similarity 0.8 miss every bucket with a chance of (1 - 0.8**5)**40 = 1.3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import small, stored
from gristmill.llm.components import components
from gristmill.llm.tokens import SPACED, blocks, grams, mix, scan, signed

#: Ids of documents to be confirmed are broadcast up to so many (8 bytes each); beyond, texts are shuffled to them.
IDS_AT_ONCE = 1_000_000
#: Members of a star that are compared with its centre in one group.
MEMBERS = 128
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each row's distinct k-word shingles as ascending hashes. Of fewer words, all of them are one."""
    text = scan(column, SPACED, fold=True)
    counts = text.counts
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(first[-1], np.uint64)
    long = np.flatnonzero(counts >= k)
    whole = grams(text.hashes, k)
    src = np.repeat(text.first[:-1][long] - first[:-1][long], sizes[long])
    to = np.repeat(first[:-1][long], sizes[long]) + np.arange(len(src)) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
    out[to] = whole[to + src] if len(src) else whole[:0]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[first[i]] = grams(text.hashes[text.first[i] : text.first[i + 1]], int(counts[i]))[0] ^ np.uint64(counts[i])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[first[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[first]


def signatures(hashes: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """(rows, bins) of non-empty sets of ascending hashes."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = row * bins + bin_of
    head = np.ones(len(cell), bool)
    head[1:] = cell[1:] != cell[:-1]
    own, filled = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    own[cell[head]], filled[cell[head]] = hashes[head], True
    out = own.copy()
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        donor = mix((np.arange(bins, dtype=np.uint64) << np.uint64(32)) + np.uint64(attempt)) % np.uint64(bins)
        at = empty - empty % bins + donor[empty % bins].astype(np.int64)
        got = filled[at]
        out[empty[got]] = own[at[got]]
        empty, attempt = empty[~got], attempt + 1
    return out.reshape(n, bins)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands): a hash of each band's bins and number."""
    n, bins = signature.shape
    part = signature.reshape(n, bands, bins // bands)
    key = np.repeat(np.arange(bands, dtype=np.uint64)[None], n, 0)
    for i in range(part.shape[2]):
        key = mix(key ^ part[:, :, i]) + np.uint64(i)
    return key


def _longs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(signed(values), pa.int64()))


def sketch(docs: DataFrame, of: Settings) -> DataFrame:
    """(doc_id, n, s1, s2, keys): size of a row's set, a 128-bit digest of it, and its buckets; empty sets have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes, first = shingle_sets(batch.column(1), of.shingle)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            keys = band_keys(signatures(hashes, np.append(first[:-1][full], first[-1]), of.bands * of.rows), of.bands) if len(full) else np.zeros((0, of.bands), np.uint64)
            total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ s))]) for s in _SEEDS]
            digests = [pa.array(signed(t[first[1:]] - t[first[:-1]]), pa.int64()) for t in total]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *digests, _longs(keys.reshape(-1), np.concatenate([[0], np.cumsum((sizes > 0) * of.bands)]))], ["doc_id", "n", "s1", "s2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame, of: Settings) -> DataFrame:
    """(id, shingles, set): the full sets of some documents, and a hash that tells those of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes, first = shingle_sets(batch.column(1), of.shingle)
            yield pa.record_batch([batch.column(0), _longs(hashes, first)], ["id", "shingles"])

    return docs.join(small(ids, IDS_AT_ONCE), "doc_id", "left_semi").mapInArrow(run, "id long, shingles array<long>").withColumn("set", F.xxhash64("shingles"))


def _confirmed(docs: DataFrame, pairs: DataFrame, of: Settings, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough, stored; sets, if given, has all that are needed."""
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    if sets is None:
        ids = stored(pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct(), "ids")
        sets = stored(_sets(docs, ids, of), "sets")
    # a star's centre goes once to each of the groups its members are dealt to, and every member's set once to its group
    size = stored(pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("long").alias("groups")), "stars")
    dealt = pairs.join(size, "u").select("u", F.pmod(F.xxhash64("v"), F.col("groups")).alias("part"), "v")
    ends = size.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("v"))
    named = lambda x: sets.select(F.col("id").alias(x), "shingles")
    rows = ends.join(named("u"), "u").unionByName(dealt.join(named("v"), "v")).select("u", "part", "v", "shingles")
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return stored(rows.mapInArrow(_alike(of.percent), "u long, v long").distinct(), "links")


def _alike(percent: int):
    """Takes stars' rows (u, part, v, shingles), the centre's own (v null) before its members', and gives the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centres = None, []
        for batch in batches:
            u, part, v = (batch.column(i) for i in range(3))
            lists = batch.column(3)
            values, first = np.asarray(lists.values).view(np.uint64), np.asarray(lists.offsets)
            stars, parts, end = np.asarray(u), np.asarray(part), np.asarray(v.is_null())
            links = []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                own = values[a:b]
                if end[i]:
                    if now != (stars[i], parts[i]):
                        now, centres = (stars[i], parts[i]), []
                    if len(own):  # a row of the centre's id may be empty
                        centres.append(own.copy())
                    continue
                for centre in centres if len(own) else ():
                    at = np.searchsorted(centre, own)
                    common = int((centre[np.minimum(at, len(centre) - 1)] == own).sum())
                    if 100 * common >= percent * (len(own) + len(centre) - common):
                        links.append(i)
                        break
            yield pa.record_batch([u.take(pa.array(links, pa.int32())), v.take(pa.array(links, pa.int32()))], ["u", "v"])

    return run


def linked(docs: DataFrame, classes: DataFrame, known: DataFrame, of: Settings) -> DataFrame:
    """(id, component) of the classes that links tie to a smaller one, by their representatives.

    docs: doc_id, text with one row for each representative at least; classes: rep, n, keys; known: links (u, v) that need
    no confirmation.
    """
    buckets = stored(classes.select("rep", "n", F.explode("keys").alias("key")), "buckets")
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(buckets.join(shared, "key").select("key", "rep", "n", "size"), "members")
    # copies differ from what they were copied from, each in its own way, so that one has most company in its buckets
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    members = stored(members.join(company, "rep").select("key", "rep", "n", F.struct(-F.col("company"), "rep", "n").alias("order")), "members")
    near = lambda x, y: 100 * F.least(F.col(x), F.col(y)) >= of.percent * F.greatest(F.col(x), F.col(y))
    centers = members.groupBy("key").agg(F.min("order").alias("c")).select("key", F.col("c.rep").alias("u"), F.col("c.n").alias("n_u"))
    stars = members.join(centers, "key").where((F.col("rep") != F.col("u")) & near("n", "n_u"))
    found = _confirmed(docs, stars.select("u", F.col("rep").alias("v")).distinct(), of).union(known)
    root = components(found)
    members = _torn(members, root)
    if members.isEmpty():
        return root
    sets = stored(_sets(docs, members.select(F.col("rep").alias("doc_id")).distinct(), of), "sets")
    if not sets.groupBy("id").count().where("count > 1").isEmpty():  # repeated rows
        sets = stored(sets.dropDuplicates(["id", "set"]), "sets")
    more = _confirmed(docs, _left_open(sets, members.select("rep", "of").distinct(), of), of, sets)
    return root if more.isEmpty() else components(found.union(more))


def _left_open(sets: DataFrame, tied: DataFrame, of: Settings) -> DataFrame:
    """Pairs (u, v) of different components that may be similar enough, by prefix, length and positional filters.

    Shingles are ordered by how many sets hold them, rarest first. Two sets of n and m shingles with enough in common
    share one of the first n - ceil(n * percent / 100) + 1, and at the first they share, the i-th and the j-th, neither
    has fewer than percent / (100 + percent) * (n + m) left. What sets of one origin share comes late in this order, after
    what each has of its own, so those too different to be linked share no shingle that counts.
    """
    # rows of one id may have several sets; `set` must be stored, as Spark would hash anew for each shingle
    flat = sets.select(F.col("id").alias("rep"), "set", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("g"))
    # counts are stored before they are joined, so that Spark can split the rows of a shingle that very many sets hold
    held = stored(flat.groupBy("g").agg(F.count("*").alias("held")).where("held > 1"), "held")
    placed = flat.join(held, "g", "left").withColumn("held", F.coalesce("held", F.lit(1))).withColumn("i", F.row_number().over(Window.partitionBy("rep", "set").orderBy("held", "g")) - 1)
    prefix = stored(placed.where((F.col("held") > 1) & (100 * (F.col("n") - F.col("i")) >= of.percent * F.col("n"))).select("rep", "n", "g", "i"), "prefix")
    # the smallest partner a shingle offers tells which places can still count
    low = stored(prefix.groupBy("g").agg(F.min("n").alias("low"), F.count("*").alias("held")).where("held > 1").select("g", "low"), "low")
    enough = lambda left, sizes: (100 + of.percent) * left >= of.percent * sizes
    some = prefix.join(low, "g").where(enough(F.col("n") - F.col("i"), F.col("n") + F.greatest(F.col("low"), F.ceil(F.col("n") * of.percent / 100)))).join(tied, "rep").select("g", "rep", "n", "i", "of")
    some = stored(some, "prefix")
    a, b = some.toDF("g", "u", "n_u", "i_u", "of_u"), some.toDF("g", "v", "n_v", "i_v", "of_v")
    can = (F.col("of_u") < F.col("of_v")) & enough(F.least(F.col("n_u") - F.col("i_u"), F.col("n_v") - F.col("i_v")), F.col("n_u") + F.col("n_v"))
    return a.join(b, "g").where(can & (100 * F.least("n_u", "n_v") >= of.percent * F.greatest("n_u", "n_v"))).select("u", "v").distinct()


def _torn(members: DataFrame, root: DataFrame) -> DataFrame:
    """The members, each with its component `of`, of the buckets that still hold several components."""
    now = members.join(root, members["rep"] == root["id"], "left").select(*members.columns, F.coalesce("component", "rep").alias("of"))
    torn = now.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("key")
    return stored(now.join(torn, "key").select(*now.columns), "torn")


def near_duplicates(docs: DataFrame, of: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked if percent / 100 of their shingles' union is common to both; component_id is the smallest
    doc_id that links lead to. A document without words, or with null text, is linked with nothing. Rows with one doc_id
    are one document. Rows with a null doc_id can't be named: they have no component and are kept. Columns other than
    doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stored(sketch(docs, of), "sketches")
    full = rows.where("n > 0 and doc_id is not null")
    # classes and ties are stored: a class with very many copies then is one side of a join, which Spark splits
    classes = stored(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    own = ["doc_id", "s1", "s2", "n"]
    reps = full.dropDuplicates(own).join(classes.withColumnRenamed("rep", "doc_id"), own).select(F.col("doc_id").alias("rep"), "n", "keys")
    # a document whose rows have different texts ties their classes
    several = stored(full.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("doc_id"), "several")
    both = full.join(small(several, IDS_AT_ONCE), "doc_id", "left_semi").join(classes, ["s1", "s2", "n"]).select("doc_id", "rep")
    known = both.join(both.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    root = linked(docs, stored(reps, "representatives"), stored(known, "known"), of)
    ties = stored(classes.join(root, F.col("rep") == F.col("id"), "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component")), "ties")
    out = rows.select("doc_id", "s1", "s2", "n").join(ties, ["s1", "s2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
