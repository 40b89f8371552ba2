"""A Katz backoff language model of the texts of regions: discounted pairs, backoff weights, scores per text."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskloom.llm.records import LOWER, REGION_ID, TEXT, partitions, slices, span_hashes, stored, word_spans
from maskloom.session import fresh_dir

#: Symbols that every task holds: the end of a text, the stand-in of a rare word, and the most frequent words.
END, OTHER, VOCABULARY = 0, 1, 1 << 17
#: Counts up to this one are discounted; most frequent pairs that every task holds; rows gathered before they are added up.
DISCOUNTED, HELD, GATHER = 5, 2 << 20, 1 << 22
#: Rows at a rare word name its neighbour: 2 s for the symbol s before it, 2 s + 1 for s after it, a rare word after it by its hash.
#: Instead of a neighbour: the rare word itself; a pair of symbols; what was settled in a text, which no model has.
LONE, PAIR, SETTLED = (1 << 62) + 1, (1 << 62) + 3, (1 << 62) + 5
#: How many tokens follow a word once, twice, ...
FOLLOWERS = [f"followers_{r}" for r in range(1, DISCOUNTED + 1)]
#: What a row of a text holds while it is scored: how often a word or pair is in it, or one of its settled sums.
OPEN, TOKENS, KNOWN, BASE, TOTAL = range(5)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of all texts, and where each text's words begin among them.

    The highest bit is set, so that as a signed number no hash is a symbol.
    """
    data = LOWER[data]
    starts, ends, at = word_spans(data, bounds)
    return span_hashes(data, starts, ends) | np.uint64(1 << 63), at


@dataclass(frozen=True)
class Vocabulary:
    """The words with symbols of their own: sorted hashes, their symbols and training counts."""
    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and training count of each word; count 0 where the word is outside."""
        if not len(self.hashes):
            return np.full(len(words), OTHER, np.int64), np.zeros(len(words), np.int64)
        place = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        own = self.hashes[place] == words
        return np.where(own, self.symbols[place], OTHER), np.where(own, self.counts[place], 0)


def pairs(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands before every token, the token, and the text it belongs to.

    A text is its words and one end; what stands before its first token is an end too.
    """
    texts = len(at) - 1
    owner = np.repeat(np.arange(texts), np.diff(at) + 1)
    line = np.full(len(ids) + texts, END, dtype=np.int64)
    line[np.arange(len(ids)) + np.repeat(np.arange(texts), np.diff(at))] = ids
    before = np.empty_like(line)
    before[:1], before[1:] = END, line[:-1]
    return before, line, owner


def named(words: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """A frequent word's symbol, a rare word's hash (which is negative)."""
    return np.where(symbols == OTHER, words.view(np.int64), symbols)


def good_turing(counts_of_counts: dict[int, int], most: int = DISCOUNTED) -> list[float]:
    """The factor on counts 1 to ``most``; 1 wherever the counts of counts give none between 0 and 1."""
    n = [counts_of_counts.get(r, 0) for r in range(most + 2)]
    out = []
    for r in range(1, most + 1):
        factor = 1.0
        if n[1] and n[r] and n[r + 1]:
            rest = (most + 1) * n[most + 1] / n[1]
            if rest < 1:
                factor = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest)
        out.append(factor if 0 < factor < 1 else 1.0)
    return out


def kept_part(factors: list[float]) -> Column:
    """The factor on the count ``n``."""
    out = F.lit(1.0)
    for r, f in enumerate(factors, 1):
        out = F.when(F.col("n") == r, F.lit(f)).otherwise(out)
    return out


def _added(chunks: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate(chunks), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def _counted(keys_of):
    """Count keys over the texts of a task, adding up whenever ``GATHER`` rows have come together."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, counts, held = [], [], 0
        for _, data, bounds in slices(batches, TEXT):
            keys, n = np.unique(keys_of(data, bounds), return_counts=True)
            chunks.append(keys)
            counts.append(n)
            held += len(keys)
            if held > GATHER:
                keys, n = _added(chunks, counts)
                chunks, counts, held = [keys], [n], len(keys)
                if held > GATHER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])
                    chunks, counts, held = [], [], 0
        if held:
            keys, n = _added(chunks, counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])
    return count


@contextmanager
def _frugal(spark: SparkSession):
    """Tables in the smaller codec, shuffles without files that nothing reads again, joins on rows that lie together by their home."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd",
           "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """:func:`stored` in the smaller codec, without the files of its shuffles, which nothing reads again."""
    with _frugal(df.sparkSession):
        return stored(df, label)


def _at_home(*parts: DataFrame) -> DataFrame:
    """One table of all ``parts``, in buckets along ``home``, so that a join there shuffles none of its rows."""
    spark = parts[0].sparkSession
    name, path = f"maskloom_{uuid.uuid4().hex}", fresh_dir(spark, "counts")
    with _frugal(spark):
        for part in parts:
            part.write.bucketBy(partitions(spark), "home").option("path", path).saveAsTable(name, mode="append")
    return spark.table(name)


def _dropped(df: DataFrame) -> None:
    """Delete the files of a :func:`_kept` table that nothing reads again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def _summed(texts: DataFrame, keys_of) -> DataFrame:
    return texts.mapInArrow(_counted(keys_of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _neighbours(texts: DataFrame, shared) -> DataFrame:
    """``home, other, n`` for each pair with a rare word: at its token if that is rare, else at its history.

    A pair of two rare words is named by its history there.
    """
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in slices(batches, TEXT):
            found, at = tokens(data, bounds)
            before, token, _ = pairs(named(found, shared.value.of(found)[0]), at)
            open_ = (before < 0) | (token < 0)
            before, token = before[open_], token[open_]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(token < 0, token, before)),
                 pa.array(np.where(token >= 0, 2 * token + 1, np.where(before < 0, before, 2 * before)))], names=["home", "other"])

    return texts.mapInArrow(rare, "home long, other long").repartition("home").groupBy("home", "other").agg(F.count("*").alias("n"))


def _rare_pairs(texts: DataFrame, shared, plain: DataFrame, total: int) -> DataFrame:
    """Each pair with a rare word once, with what the rare word it lies at has in all, and a row of each rare word itself.

    ``home``'s neighbour is ``other``, ``n`` times. ``count`` is the training count of ``home``, ``FOLLOWERS`` say how many of the
    tokens after it follow it once, twice and so on, ``after`` is the sum of their relative frequencies. ``p`` is the relative
    frequency of the pair's token where both words are rare. Such a pair lies at its history, after it has met its token.

    A rare word is less frequent than all of the vocabulary, so no word's rows are many.
    """
    own, other = Window.partitionBy("home"), F.col("other")
    at_token = _neighbours(texts, shared).withColumn("count", F.sum(F.when((other < 0) | (other % 2 == 0), F.col("n"))).over(own))
    moved = at_token.filter(other < 0).select(
        other.alias("home"), F.col("home").alias("other"), "n", F.lit(None).cast("long").alias("count"),
        (F.col("count") / (total + 1)).alias("p")).repartition("home")
    # What was moved stays without n until the count of its token is known to all its rows.
    rows = at_token.withColumns({"n": F.when(other >= 0, F.col("n")), "p": F.lit(None).cast("double")}).unionByName(moved).withColumn(
        "symbol", F.when((other >= 0) & (other % 2 == 1), F.shiftright(other, 1))).join(
        plain.select("symbol", F.col("p").alias("frequent_p")), "symbol", "left")
    after = F.col("n").isNotNull() & ((other < 0) | (other % 2 == 1))
    met = rows.select(
        "home", "other", "n", "p", F.max("count").over(own).alias("count"),
        F.sum(F.when(after, F.coalesce("p", "frequent_p"))).over(own).alias("after"),
        *[F.count(F.when(after & (F.col("n") == r), 1)).over(own).alias(c) for r, c in enumerate(FOLLOWERS, 1)],
        F.min(F.when(F.col("n").isNotNull(), other)).over(own).alias("lead")).filter("n IS NOT NULL")
    pair, lone = F.struct("other", "n", "p"), F.struct(F.lit(LONE).alias("other"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("p"))
    return met.select("home", "count", "after", *FOLLOWERS, F.explode(F.when(other == F.col("lead"), F.array(pair, lone)).otherwise(
        F.array(pair))).alias("row")).select("home", "row.*", "count", "after", *FOLLOWERS)


def _weights(kept: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divisor and log10 of the backoff weight of histories with ``n`` pairs that keep ``kept``, their tokens' frequencies being ``p``."""
    divisor = n + (n - kept < 1e-9 * n)
    return divisor, np.log10(np.where(1 - p > 1e-12, (1 - kept / divisor) / np.maximum(1 - p, 1e-12), 1e-300))


def _rare_gains(rows: DataFrame, held: DataFrame, plain: DataFrame, factors: list[float], total: int) -> DataFrame:
    """``home, other, n, gain, base, less``: the gain of each row of :func:`_rare_pairs`; pairs of symbols keep ``n`` and what it is less by."""
    home, other, n, count = (F.col(c) for c in ("home", "other", "n", "count"))
    lost = sum(F.col(c) * (r * (1 - f)) for c, (r, f) in zip(FOLLOWERS, enumerate(factors, 1)))
    divisor = count + F.when(lost < 1e-9 * count, 1).otherwise(0)
    left = 1 - F.coalesce("after", F.lit(0.0))
    weight = F.log10(F.when(left > 1e-12, (1 - (count - lost) / divisor) / F.greatest(left, F.lit(1e-12))).otherwise(1e-300))
    rare, before = home < 0, (other >= 0) & (other % 2 == 0)
    met = rows.withColumns({
        "history": F.when(~rare, F.floor(home / VOCABULARY).cast("long")).when(before, F.shiftright(other, 1)),
        "symbol": F.when(~rare, home % VOCABULARY).when((other >= 0) & ~before, F.shiftright(other, 1)),
    }).join(held, "history", "left").join(plain.withColumnRenamed("p", "frequent_p"), "symbol", "left")
    p = F.when(before, count / (total + 1)).otherwise(F.coalesce("p", "frequent_p"))
    gain = F.log10(kept_part(factors) * n / F.when(before, F.col("divisor")).otherwise(divisor)) - F.when(
        before, F.col("backoff")).otherwise(weight) - F.log10(p)
    return met.select("home", "other", F.when(~rare, n).alias("n"), F.when(rare, F.when(other == LONE, F.log10(count) + weight).otherwise(
        gain)).alias("gain"), F.when(rare & (other == LONE), F.log10(count + 1.0)).alias("base"),
        F.when(~rare, F.log10("divisor") + F.col("backoff") + F.log10("frequent_p")).alias("less"))


@dataclass(frozen=True)
class KatzModel:
    """What every task holds (bounded by the vocabulary) and the tables for the rest.

    ``first[s]`` is log10 P(s), ``backoff[h]`` log10 of the weight of h, ``pairs`` and ``gains`` the most frequent pairs
    with what their log10 probability exceeds ``backoff[h] + first[s]`` by; a rare word is taken there for one never seen.
    ``table`` has all else in buckets along ``home``: ``n`` for all other pairs of symbols, which are their own home, and what its
    logarithm is ``less`` by; ``gain`` for pairs with a rare word (``home``, with ``other`` as its neighbour) and for the rare words themselves, the latter with ``base``,
    log10(count + 1).
    ``factors`` are those on the counts 1 to ``DISCOUNTED``.
    """
    vocabulary: Vocabulary
    first: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    gains: np.ndarray
    train_tokens: int
    distinct: int
    ends: int
    factors: list[float]
    table: DataFrame

    def held(self) -> tuple:
        return (self.vocabulary, self.first, self.backoff, self.pairs, self.gains, self.train_tokens, self.distinct, self.ends)

    def met_rows(self) -> DataFrame:
        """``home, other, gain, base`` of ``table``, with the gain of pairs of symbols too."""
        return self.table.select("home", "other", F.coalesce("gain", F.log10(kept_part(self.factors) * F.col("n")) - F.col("less")).alias("gain"), "base")


def learn(regions: DataFrame) -> KatzModel:
    """A model of all texts in ``regions(region_id, original_text)``; null texts are empty ones.

    P(w | h) is the discounted relative frequency of the pair if it occurs, else ``backoff(h) * P(w)``; the weight of
    h is what its pairs leave over, divided by what P leaves over for words that do not follow h, so that the
    probabilities after h sum to 1. A history whose counts are all beyond the discounted ones leaves one count
    over. P is the relative frequency of a word or end, one count more being for words never seen. Every word has pairs of its own.

    Words and pairs are counted by all tasks and summed by key. The vocabulary has a fixed size, so the symbols,
    their weights and the ``HELD`` most frequent pairs of symbols are bounded and sent to every task. All other pairs and
    words stay in tables; a pair with a rare word is weighed where that word's pairs are. No texts give a model in which
    everything is unknown.
    """
    spark = regions.sparkSession
    texts = regions.select(TEXT)
    ends = texts.count()
    words = _kept(_summed(texts, lambda data, bounds: tokens(data, bounds)[0]), "words")
    whole = words.agg(F.count("*").alias("types"), F.sum("n").alias("n")).first()
    total, types = (whole.n or 0) + ends, whole.types + (1 if ends else 0)

    # The most frequent words, all of a count or none: as many as there is room for.
    n, times = (c.to_numpy() for c in words.groupBy("n").agg(F.count("*").alias("times")).toArrow().columns)
    order = np.argsort(-n)
    over = n[order][np.cumsum(times[order]) > VOCABULARY - 2]
    least = int(over[0]) + 1 if len(over) else 1
    top = words.filter(F.col("n") >= least).toArrow()
    _dropped(words)
    key, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(key)
    vocabulary = Vocabulary(key[order], order + 2, n[order])
    count = np.zeros(VOCABULARY)
    count[END], count[OTHER], count[2:2 + len(n)] = ends, 1, n
    with np.errstate(divide="ignore"):
        first = np.maximum(np.log10(count / (total + 1)), -300.0)

    shared = spark.sparkContext.broadcast(vocabulary)

    def pair_keys(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        found, at = tokens(data, bounds)
        before, token, _ = pairs(shared.value.of(found)[0], at)
        return (before * VOCABULARY + token)[(before != OTHER) & (token != OTHER)]

    plain = F.broadcast(spark.createDataFrame(
        pa.table({"symbol": np.flatnonzero(count), "p": (count / (total + 1))[count > 0]})))
    rare, void = _rare_pairs(texts, shared, plain, total), F.lit(None)
    counts = _at_home(
        _summed(texts, pair_keys).select(F.col("key").alias("home"), F.lit(PAIR).alias("other"), "n", *[
            void.cast(rare.schema[c].dataType).alias(c) for c in ("p", "count", "after", *FOLLOWERS)]), rare)
    spread = {r.n: r.times for r in counts.filter(F.col("n") <= DISCOUNTED + 1).groupBy("n").agg(F.count("*").alias("times")).collect()}
    shared.destroy()
    factors = good_turing(spread)
    factor = kept_part(factors)
    counted, other = counts.filter("home >= 0").select(F.col("home").alias("key"), "n"), F.col("other")
    parted = counted.select("key", "n", F.floor(F.col("key") / VOCABULARY).cast("long").alias("history"),
                            (F.col("key") % VOCABULARY).alias("symbol"), (factor * F.col("n")).alias("kept"))
    frequent = parted.join(plain, "symbol").select("history", "n", "kept", "p").unionByName(
        counts.filter("home < 0").filter((other >= 0) & (other % 2 == 0)).select(
            F.shiftright(other, 1).alias("history"), "n", (factor * F.col("n")).alias("kept"), (F.col("count") / (total + 1)).alias("p")))
    sums = _kept(frequent.groupBy("history").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.sum("p").alias("p")), "histories").toArrow()
    history, c, kept, p = (sums.column(k).to_numpy() for k in ("history", "n", "kept", "p"))
    backoff, divisors = np.zeros(VOCABULARY), np.ones(VOCABULARY)
    divisors[history], backoff[history] = _weights(kept, c, p)

    held = F.broadcast(spark.createDataFrame(pa.table({"history": history, "divisor": divisors[history], "backoff": backoff[history]})))
    # Steps of counts from the highest down, as long as there is room, and of the next one a part chosen by hash.
    step = F.floor(F.log2("n") * 8)
    steps = counted.groupBy(step.alias("step")).agg(F.count("*").alias("times")).orderBy(F.desc("step")).collect()
    is_held, room = F.lit(False), HELD
    for r in steps:
        if r.times > room:
            is_held |= (step == r.step) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(0.95 * room / r.times * (1 << 20)))
            break
        room -= r.times
        is_held = step >= r.step
    key, n = (c.to_numpy() for c in counted.filter(is_held).select("key", "n").toArrow().columns)
    order = np.argsort(key)
    key, n = key[order], n[order]
    del order
    pa.default_memory_pool().release_unused()
    kept, history = n * np.where(n <= DISCOUNTED, np.array(factors)[np.minimum(n, DISCOUNTED) - 1], 1.0), key // VOCABULARY
    gain = np.log10(kept / divisors[history]) - backoff[history] - first[key % VOCABULARY]
    rows = counts.withColumn("key", F.col("home")).filter((F.col("home") < 0) | ~is_held)
    table = _rare_gains(rows, held, plain, factors, total)
    return KatzModel(vocabulary, first, backoff, key, gain, total, types, ends, factors, table)


def score(regions: DataFrame, model: KatzModel) -> DataFrame:
    """``region_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for each row.

    ``score`` is the log10 probability of the whole ``original_text`` and its end. ``base_score`` adds up
    log10((c + 1) / (N + V + 1)) over the tokens, c being a token's training count. A null or empty text is its
    end alone. Ids may be null or repeat; equal texts have equal scores.

    What a task holds settles frequent words and pairs at once, as if all others were unknown. The others, one row
    for each text and word or pair, go to the buckets of the model's table, and what they gain is summed by text; what was settled
    comes with them, as rows that no table has. A text is named by a 64-bit digest; sums of equal texts are divided by
    their number. The scores are written before this returns.
    """
    shared = regions.sparkSession.sparkContext.broadcast(model.held())
    unknown = -math.log10(model.train_tokens + model.distinct + 1)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, first, backoff, held, gains, _, _, ends = shared.value
        for rows, data, bounds in slices(batches, TEXT):
            words, at = tokens(data, bounds)
            symbols, counts = vocabulary.of(words)
            n, names, text = len(at) - 1, rows.column(1).to_numpy(), np.repeat(np.arange(len(at) - 1), np.diff(at))
            before, token, owner = pairs(symbols, at)
            own = (before != OTHER) & (token != OTHER)
            both, times = np.unique(owner[own] * VOCABULARY ** 2 + before[own] * VOCABULARY + token[own], return_counts=True)
            owner, key = both // VOCABULARY ** 2, both % VOCABULARY ** 2
            place = np.minimum(np.searchsorted(held, key), max(len(held) - 1, 0))
            hot = held[place] == key if len(held) else np.zeros(len(key), bool)

            add = lambda of, w: np.bincount(of, weights=w, minlength=n)
            known = add(text, counts > 0) + (ends > 0)
            base = add(text, np.log10(counts + 1.0)) + math.log10(ends + 1) + (np.diff(at) + 1) * unknown
            total = add(text, first[symbols] + backoff[symbols]) + first[END] + backoff[END] + add(owner[hot], times[hot] * gains[place[hot]])

            before, token, text = pairs(named(words, symbols), at)
            pair, lone = (before < 0) | (token < 0), token < 0
            text = np.concatenate([text[pair], text[lone]])
            lone, before, token = token[lone], before[pair], token[pair]
            home = np.concatenate([np.where((token < 0) & (before >= 0), token, before), lone])
            other = np.concatenate([np.where(token >= 0, 2 * token + 1, np.where(before < 0, token, 2 * before)), np.full(len(lone), LONE)])
            order = np.lexsort((other, home, text))
            text, home, other = text[order], home[order], other[order]
            edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (home[1:] != home[:-1]) | (
                other[1:] != other[:-1])])) if len(text) else np.zeros(0, int)
            text, home, other, times = (np.concatenate(x) for x in (
                (owner[~hot], text[edge]), (key[~hot], home[edge]), (np.full(int((~hot).sum()), PAIR), other[edge]),
                (times[~hot], np.diff(np.append(edge, len(order))))))
            order = np.argsort(text, kind="stable")  # a text's rows together, so that its name packs well
            kinds = np.repeat(np.array([TOKENS, KNOWN, BASE, TOTAL], np.int8), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (
                    (home[order], np.tile(names, 4) + kinds), (other[order], np.full(4 * n, SETTLED)),
                    (names[text[order]], np.tile(names, 4)), (np.full(len(home), OPEN, np.int8), kinds),
                    (times[order], np.diff(at) + 1, known, base, total))], names=["home", "other", "name", "kind", "value"])

    name = F.xxhash64(F.coalesce(TEXT, F.lit(""))).alias("name")
    met = regions.select(TEXT, name).mapInArrow(told, "home long, other long, name long, kind byte, value double").join(
        model.met_rows().hint("merge"), ["home", "other"], "left")
    kind, value, base = F.col("kind"), F.col("value"), F.col("base")

    def summed(of: int, gain: Column) -> Column:
        return F.sum(F.when(kind == of, value).when(kind == OPEN, gain).otherwise(0.0))

    sums = met.groupBy("name").agg(
        F.count(F.when(kind == TOKENS, 1)).alias("same"), summed(TOKENS, F.lit(0.0)).alias("tokens"),
        summed(KNOWN, F.when(base.isNotNull(), value).otherwise(0.0)).alias("known"),
        summed(BASE, F.coalesce(value * base, F.lit(0.0))).alias("base"), summed(TOTAL, F.coalesce(value * F.col("gain"), F.lit(0.0))).alias("total"))

    def per(column: str) -> Column:
        return F.col(column) / F.col("same")

    scores = _kept(regions.select(REGION_ID, name).join(sums, "name").select(
        REGION_ID, F.round(per("tokens")).cast("bigint").alias("n_tokens"), F.round(per("known")).cast("bigint").alias("n_known"),
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), per("base").alias("base_score"), per("total").alias("score")), "scores")
    shared.destroy()  # the scores are written, no task needs it again
    return scores
