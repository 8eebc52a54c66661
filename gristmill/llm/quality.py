"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model of trusted text.

Counts are Spark tables over all trusted text and stay so. The interpolation unrolls: where c > 0 the probability of a word
after a context h is p(w|h) = (c - D) / S(h) + g(h) p(w|h'), with h' the context without its first word, and
log p(w|h) = log g(h) + log p(w|h') + log(1 + (c - D) / (S(h) g(h) p(w|h'))). So a document's log probability is a sum of
one weight for each n-gram it has,

    of a word: log p1(w), the interpolated continuation probability; of a context: log g(h); of an n-gram: the last term,

and what trusted text hasn't weighs nothing (a word: a constant). Scoring is one join of the documents' n-grams with the
table of weights, sharded by the n-gram's hash. A large model is scored in rounds, each for its share of all hashes: the
texts are read again in each, and no more than that share is ever shuffled or on disk at a time. N-grams frequent in trusted text
would make hot shards; the most frequent ones, a fixed number, are broadcast and summed where the text is read. So is, as
long as it can sift, a Bloom filter of fixed size that keeps n-grams the model hasn't from being shuffled. Neither changes a
result, only what the join has to carry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, scratch, small, stored
from gristmill.llm.tokens import SPACED, blocks, scan, signed

#: Most shares of all n-grams that are scored one after the other, a power of two; and so many n-grams are scored at once in
#: any case, as reading texts again would cost more than it saves.
ROUNDS, ONE_ROUND = 4, 1 << 22
#: The most frequent n-grams' weights are broadcast: this part of a round's, and no more than so many (12 bytes each).
SHARE, FREQUENT = 0.4, 1 << 20
#: 64-bit words of a round's Bloom filter, and for how many n-grams it is made.
BLOOM, BLOOM_FOR = 1 << 21, 1 << 25
#: So many words' statistics are broadcast while the model is made (about 100 bytes each); the others are joined by a shuffle.
WORDS_AT_ONCE = 1 << 18
TRUSTED_AT_ONCE = 2_000_000
#: Languages, whose thresholds are broadcast up to so many.
GROUPS_AT_ONCE = 10_000
#: N-grams that a task counts before it hands them on.
COUNTED_AT_ONCE = 1_500_000
_EDGE = np.uint64(0x5DEECE66D1CE4E5B)  # stands before the first word and after the last
_HEAD_BITS = 20


def _turn(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(2)) | (x >> np.uint64(62))


def _key(words: list[str]) -> Column:
    """The key of the n-gram in some columns, the same as `_keys` gives it; that of one word is the word."""
    return reduce(lambda k, w: F.shiftleft(k, 2).bitwiseOR(F.shiftrightunsigned(k, 62)).bitwiseXOR(F.col(w)), words[1:], F.col(words[0]))


def _names(order: int) -> list[str]:
    return [f"w{i}" for i in range(order)]


@dataclass
class _Padded:
    """The rows that have words: order - 1 edges, the words, an edge; one row after the other."""

    rows: np.ndarray
    words: np.ndarray  # of each row
    seq: np.ndarray
    row: np.ndarray  # of each element of seq
    place: np.ndarray  # in its row


def _padded(column: pa.Array, order: int) -> _Padded:
    text = scan(column, SPACED)
    rows = np.flatnonzero(text.counts)
    n = text.counts[rows]
    size = n + order
    first = np.cumsum(size) - size
    seq = np.full(int(size.sum()), _EDGE, np.uint64)
    row = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(seq)) - first[row] if len(rows) else np.zeros(0, np.int64)
    seq[(place >= order - 1) & (place < size[row] - 1) if len(rows) else slice(0)] = text.hashes
    return _Padded(rows, n, seq, row, place)


def _keys(text: _Padded, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all n-grams with a weight: words and the last edge before them; shorter n-grams, ends included, as
    what is predicted or as a context; the longest."""
    found_row, found = [], []
    key = text.seq
    end = text.place == (text.words + order - 1)[text.row] if len(text.rows) else np.zeros(0, bool)
    for m in range(1, order + 1):
        if m > 1:
            key = np.concatenate([key[:1], _turn(key[:-1]) ^ text.seq[1:]])
        at = text.place >= (order - 1 if m == order else order - 2)
        if m == 1 < order:
            at &= ~end
        found_row.append(text.row[at])
        found.append(key[at])
    return np.concatenate(found_row), np.concatenate(found)


def counts(trusted: DataFrame, order: int = 2) -> DataFrame:
    """(w0, w1, .., c): how often each n-gram of words stands in whole texts, with edges. Dealt out by the context and four
    bits of the word, so that a frequent context's n-grams go to several tasks."""
    names = _names(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def made() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            by = np.lexsort(columns[::-1])
            columns = [c[by] for c in columns]
            head = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
            n = np.diff(np.append(head, len(by)))
            return pa.record_batch([*(pa.array(signed(c[head])) for c in columns), pa.array(n, pa.int64())], [*names, "c"])

        for batch in blocks(batches):
            text = _padded(batch.column(0), order)
            at = np.flatnonzero(text.place >= order - 1)
            if len(at):
                held.append([text.seq[at - k] for k in range(order - 1, -1, -1)])
                size += len(at)
            if size >= COUNTED_AT_ONCE:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    found = trusted.select("text").mapInArrow(run, ", ".join(f"{x} long" for x in [*names, "c"]))
    found = found.withColumn("part", F.shiftrightunsigned(names[-1], 60))
    return found.repartition(*names[:-1], "part").groupBy(*names, "part").agg(F.sum("c").alias("c")).drop("part")


def _discounts(n: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times, within what keeps probabilities positive."""
    n1, n2, n3, n4 = (max(1, n.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _by_count(c: str, values: list[float]) -> Column:
    return F.when(F.col(c) == 1, values[0]).when(F.col(c) == 2, values[1]).otherwise(values[2])


def _sizes(grams: DataFrame) -> dict[int, int]:
    """How many n-grams have the count 1, 2, 3, 4 and more."""
    return {r["k"]: r["n"] for r in grams.groupBy(F.least("c", F.lit(5)).alias("k")).agg(F.count("*").alias("n")).collect()}


def _numbers(table: DataFrame, by: str) -> list[tuple[int, int]]:
    """(value of `by`, rows that have it), from the largest value down; those above 2**16 count as that."""
    return [tuple(r) for r in table.groupBy(F.least(by, F.lit(1 << 16)).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()]


def _least(numbers: list[tuple[int, int]], most: int) -> int:
    """The smallest value from which on there are no more than `most` rows."""
    least = 1 << 62
    for k, n in numbers:
        if n > most:
            break
        least, most = k, most - n
    return least


def _looked_up(rows: DataFrame, table: DataFrame, key: str, uses: str, most: int) -> DataFrame:
    """rows with the columns of `table` (key, uses, ..), which has all their keys once. Its rows of most use are broadcast,
    no more than `most`; only what is left goes through a shuffle."""
    least = _least(_numbers(table, uses), most)
    head, rest = (F.broadcast(table.where(F.col(uses) >= least).drop(uses)), table.where(F.col(uses) < least).drop(uses))
    return rows.join(head, key).unionByName(rows.join(head, key, "left_anti").join(rest, key))


@dataclass
class Model:
    """weights (key, weight, seen) of n-grams; unknown: log p1 of a word that trusted text hasn't; rounds: shares to score in."""

    weights: DataFrame
    unknown: float
    rounds: int  # 0: an empty model
    order: int


def fit(trusted: DataFrame, own: Scratch, order: int = 2, at_once: int = WORDS_AT_ONCE) -> Model:
    """The model of trusted texts (column text) from n-grams of `order` (2 or more) words. Without any words it is empty and
    scores nothing. Its table of weights is one of `own`.

    Counts of the longest n-grams are their numbers; of shorter ones, how many different words stand before them.
    """
    with scratch(trusted.sparkSession) as here:
        # tables of n-grams: n columns of words, c, seen
        grams = {order: here.stored(counts(trusted, order).withColumn("seen", F.col("c")).sortWithinPartitions(*_names(order)[:-1]), "grams")}
        for n in range(order - 1, 0, -1):
            suffix = [F.col(f"w{i + 1}").alias(f"w{i}") for i in range(n)]
            grams[n] = here.stored(grams[n + 1].groupBy(suffix).agg(F.count("*").alias("c"), F.sum("seen").alias("seen")), "grams")
        sizes = {n: _sizes(grams[n]) for n in grams}
        total = sum(sizes[2].values())
        if not total:
            return Model(own.stored(grams[1].selectExpr("w0 as key", "cast(c as float) as weight", "seen"), "weights"), 0.0, 0, order)
        d = {n: _discounts(sizes[n]) for n in grams}
        spare = sum(d[1][min(k, 3) - 1] * v for k, v in sizes[1].items()) / total / (sum(sizes[1].values()) + 1)
        unknown = float(np.log(spare))
        # p: the probability of an n-gram's last word after the others
        p = grams[1].select(F.col("w0").alias("key"), ((F.col("c") - _by_count("c", d[1])) / total + spare).alias("p"), "c", "seen")
        parts = [p.select("key", (F.log("p") - unknown).alias("weight"), "seen")]
        for n in range(2, order + 1):
            names = _names(n)
            rows = grams[n].select(_key(names[:-1]).alias("context"), _key(names[1:]).alias("suffix"), _key(names).alias("key"), (F.col("c") - _by_count("c", d[n])).alias("more"), "c", "seen")
            contexts = here.stored(rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum(_by_count("c", d[n])).alias("mass"), F.count("*").alias("uses")), "contexts")
            parts.append(contexts.select(F.col("context").alias("key"), F.log(F.col("mass") / F.col("total")).alias("weight"), F.col("total").alias("seen")))
            rows = _looked_up(rows, contexts, "context", "uses", at_once)
            rows = _looked_up(rows, p.select(F.col("key").alias("suffix"), F.col("p").alias("lower"), F.col("c").alias("uses")), "suffix", "uses", at_once)
            last = rows.select("key", F.log1p(F.col("more") / F.col("mass") / F.col("lower")).alias("weight"), "seen")
            if n < order:
                p = here.stored(rows.select("key", (F.col("more") / F.col("total") + F.col("mass") / F.col("total") * F.col("lower")).alias("p"), "c", "seen"), "probabilities")
                parts.append(last)
        # a key is that of a word or shorter n-gram and of a context; the longest n-grams are no contexts
        short = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("weight").alias("weight"), F.max("seen").alias("seen"))
        weights = own.stored(short.unionByName(last).select("key", F.col("weight").cast("float").alias("weight"), "seen"), "weights")
        n, rounds = weights.count(), 1
        while rounds < ROUNDS and n > rounds * ONE_ROUND:
            rounds *= 2
        return Model(weights, unknown, rounds, order)


def _round(key: str, rounds: int) -> Column:
    return F.shiftrightunsigned(key, 30).bitwiseAND(F.lit(rounds - 1).cast("long"))


def _bloom_bits(x: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return (one << ((x >> np.uint64(40)) & np.uint64(63))) | (one << ((x >> np.uint64(46)) & np.uint64(63))) | (one << ((x >> np.uint64(52)) & np.uint64(63)))


@dataclass
class Lookup:
    """What goes to the tasks: weights of the most frequent keys, sorted, where each value of the upper bits begins among
    them, and the filter of all keys (None: all may be in the model)."""

    keys: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    bloom: np.ndarray | None

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight or 0, whether the key must be joined)."""
        weight, open_ = np.zeros(len(x)), np.zeros(len(x), bool)
        left = np.arange(len(x)) if self.bloom is None else np.flatnonzero(((bits := _bloom_bits(x)) & self.bloom[(x & np.uint64(BLOOM - 1)).astype(np.int64)]) == bits)
        bucket = (x[left] >> np.uint64(64 - _HEAD_BITS)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        while len(left):
            over = at >= end
            open_[left[over]] = True
            left, at, end = left[~over], at[~over], end[~over]
            hit = self.keys[at] == x[left]
            weight[left[hit]] = self.weights[at[hit]]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return weight, open_


def _lookup(weights: DataFrame, frequent: int) -> tuple[Lookup, DataFrame]:
    """The broadcast part of a round's weights, and those left for the join."""
    numbers = _numbers(weights, "seen")
    n = sum(x for _, x in numbers)
    least = _least(numbers, min(frequent, int(SHARE * n)))
    head = weights.where(F.col("seen") >= least).select("key", "weight").toArrow()
    keys = head.column(0).to_numpy().view(np.uint64)
    by = np.argsort(keys)
    starts = np.searchsorted(keys[by] >> np.uint64(64 - _HEAD_BITS), np.arange((1 << _HEAD_BITS) + 1, dtype=np.uint64)).astype(np.int32)
    bloom = None
    if n <= BLOOM_FOR:
        word = F.col("key").bitwiseAND(F.lit(BLOOM - 1))
        bit = lambda at: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {at}) & 63 as int))")
        table = weights.select(word.alias("i"), bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52)).alias("bits")).groupBy("i").agg(F.bit_or("bits").alias("bits")).toArrow()
        bloom = np.zeros(BLOOM, np.uint64)
        bloom[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)
    return Lookup(keys[by], head.column(1).to_numpy()[by], starts, bloom), weights.where(F.col("seen") < least).select("key", "weight")


def scores(docs: DataFrame, model: Model, own: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """(of, n_tokens, log_perplexity) of each distinct text that has words: of is xxhash64(text), log_perplexity the mean
    negative log probability of a word, the end of the text counting as one; null for all if the model is empty.

    docs: of, text without nulls. What is stored of each round is one of `own`'s. Copies are scored once an Arrow batch, and as often as batches have them; the mean of
    these equal sums is taken, so neither places nor orders of rows count.
    """
    order, unknown, rounds = model.order, model.unknown, model.rounds
    done = []
    for k in range(max(1, rounds)):
        lookup, rest = _lookup(model.weights.where(_round("key", rounds) == k), frequent) if rounds else (None, model.weights.select("key", "weight").limit(0))
        shared = docs.sparkSession.sparkContext.broadcast(lookup)

        def run(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                _, first = np.unique(np.asarray(batch.column(0), np.int64), return_index=True)
                batch = batch.take(pa.array(first))
                text = _padded(batch.column(1), order)
                of = np.asarray(batch.column(0), np.int64)[text.rows]
                n, none = len(of), np.zeros(0, np.int64)
                if shared.value is None:
                    row, key, known = none, none.view(np.uint64), np.zeros(n)
                else:
                    row, key = _keys(text, order)
                    here = ((key >> np.uint64(30)) & np.uint64(rounds - 1)) == np.uint64(k)
                    row, key = row[here], key[here]
                    weight, open_ = shared.value.of(key)
                    known = np.bincount(row, weight, n)
                    row, key = row[open_], key[open_]
                gap = np.arange(n + len(row)) >= n
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([of, of[row]])),
                        pa.array(np.concatenate([of, signed(key)])),
                        pa.array(np.concatenate([known, np.zeros(len(row))]), mask=gap),
                        pa.array(np.concatenate([text.words, row]), pa.int64(), mask=gap),
                    ],
                    ["of", "key", "known", "n"],
                )

        found = docs.select("of", "text").mapInArrow(run, "of long, key long, known double, n long")
        found = found.join(rest, "key", "left").groupBy("of").agg(F.sum(F.coalesce("known", "weight", F.lit(0.0))).alias("total"), F.count("known").alias("copies"), F.max("n").alias("n"))
        done.append(own.stored(found.select("of", (F.col("total") / F.col("copies")).alias("total"), "n"), "round"))
        shared.destroy()
    out = reduce(DataFrame.unionByName, done).groupBy("of").agg(F.sum("total").alias("total"), F.max("n").alias("n_tokens"))
    if not rounds:
        return out.select("of", "n_tokens", F.lit(None).cast("double").alias("log_perplexity"))
    return out.select("of", "n_tokens", (-(F.col("total") + unknown * (F.col("n_tokens") + 1)) / (F.col("n_tokens") + 1)).alias("log_perplexity"))


def quantiles(values: DataFrame, q: float) -> DataFrame:
    """(group, threshold): in each group the smallest x for which a part q of its values is no greater; exact to 1e-8.

    values: group, x. Values are counted in pieces of the scale, and those of the piece that has the threshold once more in
    finer ones: no task gets more of a group than the counts of its pieces, ten thousand for a unit of x.
    """
    start = F.expr("named_struct('before', 0L, 'piece', cast(null as long), 'most', cast(null as double))")

    def step(s: Column, x: Column) -> Column:
        """The pieces of a group in order, up to the first with which there are `rank` values."""
        after = s["before"] + x["n"]
        here = F.struct(s["before"].alias("before"), x["piece"].alias("piece"), x["most"].alias("most"))
        further = F.struct(after.alias("before"), s["piece"].alias("piece"), s["most"].alias("most"))
        return F.when(s["piece"].isNotNull(), s).when(after >= F.col("rank"), here).otherwise(further)

    def found(values: DataFrame, digits: int, rank: Column) -> DataFrame:
        sizes = values.groupBy("group", F.floor(F.col("x") * 10**digits).alias("piece")).agg(F.count("*").alias("n"), F.max("x").alias("most"), F.max("rank").alias("rank"))
        lists = sizes.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("piece", "n", "most"))).alias("pieces"), rank.alias("rank"))
        at = lists.select("group", "rank", F.aggregate("pieces", start, step).alias("at"))
        return stored(at.select("group", (F.col("rank") - F.col("at.before")).alias("rank"), F.col("at.piece").alias("in"), F.col("at.most").alias("threshold")), "quantiles")

    first = found(values.withColumn("rank", F.lit(0).cast("long")), 4, F.ceil(F.sum("n") * F.lit(q)).cast("long"))
    inside = values.join(small(first.select("group", "rank", "in"), GROUPS_AT_ONCE), "group").where(F.floor(F.col("x") * 10**4) == F.col("in"))
    return found(inside, 8, F.max("rank")).select("group", "threshold")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, order: int = 2) -> DataFrame:
    """(key, doc_id, lang, n_tokens, log_perplexity, threshold, kept) for every row of docs; key is xxhash64(doc_id, text),
    with null texts as empty.

    Trusted are documents labelled with quality 1 and toxic 0. Four fifths of them, by a hash of doc_id, are the model's
    text; the last fifth, which it hasn't seen, gives each language's threshold: the `quantile` of its log perplexity.
    A language without such documents, or null, takes the quantile over all of them. Rows above it are rejected, and so
    are rows without words. Without trusted text, or without any in the last fifth, every row with words is kept. A null
    doc_id has no label. Repeated rows are judged each for itself, and equal texts of one language alike.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("*", F.xxhash64("text").alias("of"))
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    trusted = stored(trusted.withColumn("last", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4), "trusted")
    with scratch(docs.sparkSession) as own:
        model = fit(docs.join(small(trusted.where("not last").select("doc_id"), TRUSTED_AT_ONCE), "doc_id", "left_semi"), own, order)
        scored = own.stored(scores(docs, model, own), "scores")  # so that rows of a text with very many copies split
        rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "of", "doc_id", "lang").join(scored, "of", "left")
        rows = stored(rows.select("key", "doc_id", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "log_perplexity"), "scored")
    held = rows.join(small(trusted.where("last").select("doc_id"), TRUSTED_AT_ONCE), "doc_id", "left_semi").where("log_perplexity is not null")
    # every value is one of all ("") and, with a language, one of that ("=" and its name)
    groups = F.array_compact(F.array(F.lit(""), F.concat(F.lit("="), "lang")))
    cut = quantiles(held.select(F.explode(groups).alias("group"), F.col("log_perplexity").alias("x")), quantile)
    overall = cut.where("group = ''").select("threshold").first()
    by_lang = cut.where("group <> ''").select(F.expr("substr(group, 2)").alias("lang"), "threshold")
    out = rows.join(small(by_lang, GROUPS_AT_ONCE), "lang", "left")
    threshold = F.coalesce("threshold", F.lit(overall and overall[0]).cast("double"))
    return out.select("key", "doc_id", "lang", "n_tokens", "log_perplexity", threshold.alias("threshold"), ((F.col("n_tokens") > 0) & F.coalesce(F.col("log_perplexity") <= threshold, F.lit(True))).alias("kept"))
