"""Which tokens of two tokenizers cover the same bytes of a region's text: groups by pointer jumping, links counted over all texts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from maskloom.llm.byte_bpe import byte_characters
from maskloom.llm.records import REGION_ID, TEXT, slices, stored, texts_of

#: Pieces a task remembers (and bytes of what it keeps of them) before it begins anew; rows of counts gathered before they are added up.
PIECES, PIECE_BYTES, GATHER = 300_000, 48 << 20, 1 << 22
#: Most pairs of ids whose counts are sent to every task: the most frequent ones. All others are joined.
HELD = 1 << 20
_WIDE = re.compile(r"\s\s")
_PLAIN_BLANK = re.compile(r"(?<=\S) (?=\S)")


def read_model(path: str) -> bytes:
    """A tokenizer file, read once on the driver; it has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


def pieces_of(text: str) -> list[str]:
    """Cut a text where both tokenizers begin a new token: at single blanks between two characters that are no white space.

    Each piece is encoded with a blank before it, so joined they are a blank and the text.
    """
    if _WIDE.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _PLAIN_BLANK.split(text)
    return text.split(" ")


def successors(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every token (those of A, then those of B) the farthest-right token that overlaps it; the last of a group is its own.

    Both sides cover the same bytes without a gap. Of two tokens with one end, B's counts as farther right.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the token of B that holds the last byte
    over_b = np.searchsorted(ends_a, ends_b)
    own = n + np.arange(len(ends_b))
    return np.concatenate([n + over_a, np.where(ends_a[over_b] > ends_b, over_b, own)])


def terminals(successor: np.ndarray) -> np.ndarray:
    """The token at which following ``successor`` ends, by doubling: every round each token points twice as far."""
    while True:
        farther = successor[successor]
        if (farther == successor).all():
            return farther
        successor = farther


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B of every two tokens with a byte in common, each pair once, from left to right."""
    cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)] if len(cuts) else cuts
    return np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


class Aligner:
    """Encodes pieces of text by both tokenizers, aligns them, and remembers each distinct piece.

    ``a`` is a tokenizers file with byte-level entries, ``b`` a sentencepiece file that adds a blank itself.
    """

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte_of = {c: n for n, c in enumerate(byte_characters())}
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.width_a, self.width_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # Every id with each character that may follow it: the next of its side, the end of A's side, of a group, of a piece.
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = [f"{i}{mark}" for mark in ",|;\n" for i in range(most)]
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held, self.used = 0, 0
        self.shown: list[str] = []
        self.numbers = np.zeros((1024, 4), np.int64)  # tokens of A, of B, groups, links; -1 where bytes differ
        self.starts, self.pairs = np.zeros(1025, np.int64), np.zeros(4096, np.int64)

    def full(self) -> bool:
        return len(self.place) > PIECES or self.held > PIECE_BYTES

    def learn(self, texts: list[list[str]]) -> None:
        """Encode and align the pieces not yet known."""
        place = self.place
        new = [p for p in {p for own in texts for p in own} if p not in place]
        if not new:
            return
        # Many pieces in a row are one text to A, cut again by bytes; those that begin or end with white space stand alone.
        new.sort(key=lambda p: not p or p[0].isspace() or p[-1].isspace())
        want = [b" " + p.encode() for p in new]
        ids_a = self._encoded_a(new, want)
        ids_b = self.b.encode(new, num_threads=1)
        sound = self._sound(want, ids_a, self.bytes_a) & self._sound(want, ids_b, self.bytes_b)
        good = np.flatnonzero(sound).tolist()
        count_a, count_b = (np.array([len(ids[k]) for k in good], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for k in good for i in ids[k]], np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        label = terminals(successors(ends_a, ends_b))
        i, j = overlaps(ends_a, ends_b)
        of_a, of_b = np.repeat(np.arange(len(good)), count_a), np.repeat(np.arange(len(good)), count_b)
        last = np.flatnonzero(label[len(a):] == len(a) + np.arange(len(b)))
        shown = iter(self._shown(a, b, label, np.cumsum(count_b) - 1))

        first, n = len(self.place), len(new)
        self.place.update(zip(new, range(first, first + n)))
        if first + n > len(self.numbers):
            size = 2 * (first + n)
            self.numbers = np.concatenate([self.numbers[:first], np.zeros((size - first, 4), np.int64)])
            self.starts = np.concatenate([self.starts[:first + 1], np.zeros(size - first, np.int64)])
        own = np.full((n, 4), -1, np.int64)
        own[good] = np.column_stack([count_a, count_b, np.bincount(of_b[last], minlength=len(good)), np.bincount(of_a[i], minlength=len(good))])
        self.numbers[first:first + n] = own
        self.starts[first + 1:first + n + 1] = self.starts[first] + np.cumsum(np.maximum(own[:, 3], 0))
        more = a[i] << 32 | b[j]
        if self.used + len(more) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs[:self.used], np.zeros(self.used + 2 * len(more), np.int64)])
        self.pairs[self.used:self.used + len(more)] = more
        self.used += len(more)
        self.shown += [next(shown) if s else "" for s in sound.tolist()]
        self.held += sum(map(len, new)) + sum(map(len, self.shown[first:])) + 8 * len(more)

    def _encoded_a(self, pieces: list[str], want: list[bytes]) -> list[list[int]]:
        plain = next((k for k, p in enumerate(pieces) if not p or p[0].isspace() or p[-1].isspace()), len(pieces))
        groups = [pieces[k:min(k + 256, plain)] for k in range(0, plain, 256)] + [[p] for p in pieces[plain:]]
        out: list[list[int]] = []
        for group, e in zip(groups, self.a.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = e.ids
            if len(group) == 1:
                out.append(ids)
                continue
            bytes_to = np.cumsum([len(w) for w in want[len(out):len(out) + len(group)]])
            cuts = np.searchsorted(np.cumsum(self.width_a[ids]), bytes_to, side="right").tolist()
            out += [ids[x:y] for x, y in zip([0, *cuts[:-1]], cuts)]
        return out

    @staticmethod
    def _sound(want: list[bytes], ids: list[list[int]], table: list[bytes]) -> np.ndarray:
        """Which pieces' tokens join to the bytes wanted."""
        return np.array([b"".join([table[i] for i in x]) == w for x, w in zip(ids, want)], bool)

    def _shown(self, a: np.ndarray, b: np.ndarray, label: np.ndarray, ends: np.ndarray) -> list[str]:
        """For each piece its groups as ``a1,a2|b1;a3|b2``; ``ends`` are the places of the pieces' last tokens of B."""
        if not len(a):
            return []
        side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        order = np.argsort(label * 2 + side, kind="stable")
        ids, own, side = np.concatenate([a, b])[order], label[order], side[order]
        mark = np.zeros(len(ids), np.int64)
        turn = np.append((own[1:] != own[:-1]) | (side[1:] != side[:-1]), True)
        mark[turn] = 1 + side[turn]
        closing = np.zeros(len(ids), bool)
        closing[len(a) + ends] = True
        mark[closing[order]] = 3
        return "".join(map(self.written.__getitem__, (mark * self.most + ids).tolist())).split("\n")[:-1]

    def pairs_of(self, places: np.ndarray) -> np.ndarray:
        """The linked pairs of ids of these pieces, one after the other."""
        length = self.numbers[places, 3]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.pairs[np.repeat(self.starts[places] - ends + length, length) + np.arange(total)]


_loaded: dict[int, Aligner] = {}
_LINK = "array<struct<a: int, b: int, times: int>>"


def _aligner(models: tuple[bytes, bytes]) -> Aligner:
    key = hash(models)
    if key not in _loaded:
        _loaded[key] = Aligner(*models)
    return _loaded[key]


def aligned_texts(regions: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """Each row's ``region_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` and ``links``.

    A blank and the whole ``original_text`` are encoded by ``a`` (tokenizers file, byte-level) and ``b`` (sentencepiece file);
    nothing in a text is a special token. Tokens that share bytes are linked; ``n_links`` counts the pairs and ``links`` lists each
    pair of ids, ordered, with its ``times``. Groups lie between the bytes at which tokens of both end: every token points to its
    farthest-right overlapping token, and doubling these pointers leads each to the last token of its group. ``groups`` is
    their ids as text, ``a1,a2|b1;a3|b2``.

    A null or empty text, and one whose tokens do not join to a blank and the text, has no tokens: numbers are 0, ``groups`` is
    empty and there are no links. Ids may be null or repeat; rows are not compared, other columns are ignored, no rows give no
    rows. Nothing is shuffled. A task holds about 1 MB of text or its longest text, and the pieces it remembers.
    """
    shared = regions.sparkSession.sparkContext.broadcast((a, b))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for rows, data, bounds in slices(batches, TEXT):
            whole = [t.decode("utf-8", "replace") for t in texts_of(data, bounds)]
            texts = [pieces_of(t) if t else [] for t in whole]
            aligner.learn(texts)
            numbers, shown = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
            pairs, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            place, length = aligner.place, np.zeros(len(texts), np.int64)
            for k, own in enumerate(texts):
                places = np.array([place[p] for p in own], np.int64)
                if not len(places) or (aligner.numbers[places, 3] < 0).any():
                    continue
                numbers[k] = aligner.numbers[places].sum(axis=0)
                shown[k] = ";".join([aligner.shown[p] for p in places.tolist()])
                linked, n = np.unique(aligner.pairs_of(places), return_counts=True)
                pairs.append(linked)
                times.append(n)
                length[k] = len(linked)
            if aligner.full():
                aligner.forget()
            pair = np.concatenate(pairs)
            parts = [pair >> 32, pair & 0xFFFFFFFF, np.concatenate(times)]
            values = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in parts], ["a", "b", "times"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(numbers[:, c]) for c in range(4)], pa.array(shown), pa.ListArray.from_arrays(offsets, values)], names=names)
        aligner.forget()  # an idle worker should not hold it

    names = [REGION_ID, "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    id_type = regions.select(REGION_ID).schema[0].dataType.simpleString()
    return regions.select(REGION_ID, TEXT).mapInArrow(
        align, f"{REGION_ID} {id_type}, {', '.join(n + ' long' for n in names[1:5])}, groups string, links {_LINK}")


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, times and the row of each of all links of a batch."""
    links = batch.column(batch.schema.get_field_index("links"))
    offsets = links.offsets.to_numpy()
    values = links.values.slice(offsets[0], offsets[-1] - offsets[0])
    a, b, times = (values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
    return a << 32 | b, times, np.repeat(np.arange(batch.num_rows), np.diff(offsets))


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair`` (A's id times 2^32 plus B's id), ``count`` and ``best`` for each pair of ids linked in any row of ``aligned(links)``.

    ``count`` says how many links of all texts are of these two ids; ``best`` marks, for each id of B, the pairs with most (ties
    included). Tasks add up their links before anything is shuffled. An id of B has no more pairs than A has ids, so a
    window over it is bounded. Rows that repeat count each time; no links give no rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            pair, times, _ = _flat(batch)
            for at in range(0, len(pair), GATHER):
                keys.append(pair[at:at + GATHER])
                counts.append(times[at:at + GATHER])
                held += len(keys[-1])
                if held > GATHER:
                    found, n = _added(keys, counts)
                    keys, counts, held = [found], [n], len(found)
                    if held > GATHER // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "count"])
                        keys, counts, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(keys, counts)], names=["pair", "count"])

    counted = aligned.select("links").mapInArrow(count, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return counted.select("pair", "count", (F.col("count") == most).alias("best"))


def _frequent(counts: DataFrame, most: int) -> Column:
    """A condition on ``count`` that no more than ``most`` of the most frequent pairs meet: whole steps of counts, from the top."""
    step = F.floor(F.log2("count") * 8)
    room, lowest = most, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if r.n > room:
            break
        room, lowest = room - r.n, r.step
    return step >= lowest if lowest is not None else F.lit(False)


def with_counts(aligned: DataFrame, counts: DataFrame, held: int = HELD) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` in place of ``links``.

    ``counts`` is :func:`link_counts` of the whole corpus. ``count_sum`` adds up the counts of a text's links, ``n_best`` counts those
    links whose pair is ``best``. A task holds the ``held`` most frequent pairs; the other links are joined with ``counts`` by pair, a row
    for each text and pair, and summed by row. Rows are kept apart whatever their ids; columns of these names are replaced.
    """
    frequent = _frequent(counts, held)
    top = counts.filter(frequent).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    hot = aligned.sparkSession.sparkContext.broadcast(
        tuple(top.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "count", "best")))
    kept = [f for f in aligned.schema if f.name not in ("links", "n_best", "count_sum")]
    names = ["_row", *[f.name for f in kept], "_best", "_sum", "_rare"]
    rare = ArrayType(StructType([StructField("pair", LongType()), StructField("times", LongType())]))
    schema = StructType([StructField("_row", LongType()), *kept, StructField("_best", LongType()), StructField("_sum", LongType()), StructField("_rare", rare)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = hot.value
        for batch in batches:
            pair, times, row = _flat(batch)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            found = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            n, at, of = batch.num_rows, at[found], row[found]
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            np.add.at(sums[0], of, times[found] * best[at])
            np.add.at(sums[1], of, times[found] * count[at])
            values = pa.StructArray.from_arrays([pa.array(pair[~found]), pa.array(times[~found])], ["pair", "times"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=n))]).astype(np.int32)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names[:-3]]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(s) for s in sums], pa.ListArray.from_arrays(pa.array(offsets), values)], names=names)

    numbered = aligned.select(F.monotonically_increasing_id().alias("_row"), *[f"`{f.name}`" for f in kept], "links")
    settled = stored(numbered.mapInArrow(settle, schema), "settled")
    open_ = settled.select("_row", F.explode("_rare").alias("link")).select("_row", "link.pair", "link.times")
    more = open_.join(counts.filter(~frequent).hint("merge"), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_more_best"), F.sum(F.col("times") * F.col("count")).alias("_more_sum"))
    return settled.drop("_rare").join(more, "_row", "left").select(
        *[f"`{f.name}`" for f in kept], (F.col("_best") + F.coalesce("_more_best", F.lit(0))).alias("n_best"),
        (F.col("_sum") + F.coalesce("_more_sum", F.lit(0))).alias("count_sum"))
