"""Similarity join of texts on word n-grams: Jaccard similarity by PartEnum signatures.

Words are runs of other than blank, tab, line feed, VT, FF and CR, A-Z lower-cased; a text's set are its distinct
shingles of ``SHINGLE`` words, or its whole sequence if it has fewer.  Two sets link when 100 * intersection >= ``PERCENT``
* union, that is, when they differ by at most k = (100 - PERCENT) / (100 + PERCENT) of the sum of their sizes.

Sizes are dealt into bands.  A set takes part in its own band and in those above that a partner could lie in, so that a
pair meets in the band of its larger set, with k from the band's greatest size.  In a band the feature domain is
partitioned, by a hash, into ``parts`` first-level parts of ``cells`` second-level ones.  More than ``spare`` parts of a
pair differ in so few cells that two cells of theirs agree, so every two cells of a part make a signature.

A signature of two empty cells says nothing and would be shared by many sets, so it is left out.  A pair whose agreeing
cells are all empty then has more than ``spare`` parts with two empty cells in both its sets; every such set also gives
the signatures of another partition (``LEVELS`` of them, the last one with its empty cells), where the pair meets.  So
each pair that links shares a signature; there is no chance in it.

Equal sets are one text from the start.  Signatures are counted in buckets of their first bits, by the next 32 bits of
each; a text whose signature only seems to be shared falls out when whole signatures are compared.  Only texts with one
that another text has too are kept with their words.  A signature first links its texts to the one of least number only
(each text is compared with its most frequent such centre, then with the others that are of another class); signatures
whose texts are then in several classes are settled by comparing all members of different classes, in blocks, many
signatures at once.  Pairs are compared by their sizes and a parity sketch first, and only those that pass
exactly by their words.  Classes are connected components (large-star, small-star).

Defined results: a text that is null or has no word has the empty set and links with nothing; repeated rows and equal
sets are one class; the class id is the least id of the class (null if it has none); an empty table gives no rows;
further columns are ignored.  Sets and shingles are compared by hashes of 128 and 64 bits, words by those of 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _words as W
from quillspark.llm._shared import Bitmap, Workspace, membership, salted_join
from quillspark.llm.near_dedup import BLOCK_MEMBERS, BLOCK_SHINGLES, connected_components, shingles

SHINGLE = 4
PERCENT = 85
#: Greatest size of a band over its least; and the k up to which a single part is used.
BAND = 1.38
SINGLE = 5
LEVELS = 4
LEAST_BITS = 1024
FLAGS = 1 << 20
#: Shingles for each bucket of signatures, about; signatures that a task holds; bytes of sketches or words of a pack of groups, about.
BUCKET_SHINGLES = 1 << 19
HELD = 1 << 21
PACK_BYTES = 1 << 22
#: Places of a key in the bitmap of crowded keys, each a rotation of its bits.
TURNS = (0, 16, 32, 48)
#: Bytes of everything but blanks.
KINDS = np.ones(256, dtype=bool)
KINDS[[9, 10, 11, 12, 13, 32]] = False


def _bands() -> np.ndarray:
    first = [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, int(np.ceil(first[-1] * BAND))))
    return np.array(first)


#: Least size of each band.
FIRST = _bands()


def most_apart(total: int | np.ndarray, percent: int = PERCENT):
    """How many features two linked sets of so many features together can differ by."""
    return (100 - percent) * total // (100 + percent)


@dataclass(frozen=True)
class Scheme:
    """How a band is partitioned: first-level parts, cells of each, and parts more than needed."""

    parts: int
    cells: int
    spare: int

    @staticmethod
    def of(k: int) -> Scheme:
        if k <= SINGLE:
            # k differences leave two of k + 2 cells alike
            return Scheme(1, k + 2, 0)
        needed = k // 2 + 1
        spare = 1 + needed // 12
        # of so many parts more than ``spare`` hold at most one difference each, which leaves two of three cells alike
        return Scheme(needed + spare, 3, spare)


def signatures(hashes: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the text of each, of texts whose distinct shingle hashes lie end to end."""
    first = np.concatenate([[0], np.cumsum(counts)])
    band = np.searchsorted(FIRST, counts, "right") - 1
    top = np.searchsorted(FIRST, counts * 100 // percent, "right") - 1
    texts, tags = [], []
    for up in range(int((top - band).max(initial=0)) + 1):
        own = np.flatnonzero((counts > 0) & (band + up <= top))
        texts.append(own)
        tags.append(band[own] + up)
    text, tag = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (texts, tags))
    k = most_apart(2 * (FIRST[tag + 1] - 1), percent)
    # where nothing may differ, sets are equal, and equal sets are one text
    text, tag, k = text[k > 0], tag[k > 0], k[k > 0]
    schemes = [Scheme.of(int(x)) for x in k]
    parts, cells, spare = (np.array([getattr(s, f) for s in schemes], np.int64) for f in ("parts", "cells", "spare"))
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    live = np.arange(len(text))
    for level in range(LEVELS):
        if not len(live):
            break
        again = []
        for width in np.unique(cells[live]).tolist():
            units = live[cells[live] == width]
            keys, unit, short = _unit_signatures(hashes, first[text[units]], counts[text[units]], tag[units] * LEVELS + level, parts[units], width, spare[units], level == LEVELS - 1)
            out.append(keys)
            of.append(text[units[unit]])
            again.append(units[short])
        live = np.concatenate(again)
    return np.concatenate(out), np.concatenate(of)


def _unit_signatures(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, seeds: np.ndarray, parts: np.ndarray, width: int, spare: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets (hashes[first:first + count]) with the set of each, and the sets that need another level."""
    unit = np.repeat(np.arange(len(first)), counts)
    at = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts) + first[unit]
    seed = W.mix(seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    e = W.mix(hashes[at] ^ seed[unit])
    low = np.uint64(32)
    part = ((e >> low) * parts[unit].astype(np.uint64)) >> low
    cell = ((e & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> low
    begin = np.concatenate([[0], np.cumsum(parts)])
    place = (begin[unit] + part.astype(np.int64)) * width + cell.astype(np.int64)
    value, n = W.mix(e + np.uint64(0xD1342543DE82EF95)), int(begin[-1]) * width
    # sums of 32-bit halves are exact in doubles
    halves = [np.bincount(place, (x).astype(np.float64), n).astype(np.uint64) for x in (value & np.uint64(0xFFFFFFFF), value >> low)]
    content = W.mix(halves[0] * np.uint64(0xA0761D6478BD642F) + halves[1]).reshape(-1, width)
    empty = (np.bincount(place, minlength=n) == 0).reshape(-1, width)
    owner = np.repeat(np.arange(len(first)), parts)
    salt = seed[owner] + (np.arange(len(owner)) - begin[owner]).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    keys, units, hollow = [], [], np.zeros(len(owner), bool)
    for number, (i, j) in enumerate(combinations(range(width), 2)):
        none = empty[:, i] & empty[:, j]
        hollow |= none
        own = np.arange(len(owner)) if last else np.flatnonzero(~none)
        keys.append(W.mix(salt[own] + content[own, i] * np.uint64(0x8EBC6AF09C88C6E3) + W.mix(content[own, j] + np.uint64(number))))
        units.append(owner[own])
    short = np.bincount(owner, hollow, len(first)) > spare
    return np.concatenate(keys), np.concatenate(units), np.flatnonzero(short)


@dataclass
class Sets:
    """Distinct shingle hashes of the texts of a chunk, end to end, their counts and two halves of each set's hash."""

    words: W.Words
    hashes: np.ndarray
    counts: np.ndarray
    halves: tuple[np.ndarray, np.ndarray]

    def marks(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each text's set and of its row's id, which tells one of several equal texts."""
        return W.mix(self.halves[0] + W.mix(ids[self.words.lo : self.words.hi].view(np.uint64)))


def first_seen(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each shingle is the first of its kind in its text.  One sort of plain values tells which could be repeated,
    and only those are put in order with their texts."""
    key = W.mix(grams + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    seen = np.zeros(FLAGS, bool)
    seen[ordered[1:][ordered[1:] == ordered[:-1]] & np.uint64(FLAGS - 1)] = True
    some = np.flatnonzero(seen[key & np.uint64(FLAGS - 1)])
    some = some[np.lexsort((grams[some], doc[some]))]
    new = np.ones(len(grams), bool)
    new[some[1:]] = (grams[some[1:]] != grams[some[:-1]]) | (doc[some[1:]] != doc[some[:-1]])
    return new


def sets(column: pa.Array) -> Iterator[Sets]:
    for w in W.words(column, KINDS, W.LOWER):
        grams, doc = shingles(w, SHINGLE)
        new = first_seen(grams, doc)
        grams, doc = grams[new], doc[new]
        counts = np.bincount(doc, minlength=w.hi - w.lo)
        halves = []
        for seed in (0x589965CC75374CC3, 0x1D8E4E27C47D124F):
            total = np.zeros(len(counts), np.uint64)
            has = counts > 0
            if has.any():
                total[has] = np.add.reduceat(W.mix(grams ^ np.uint64(seed)), (np.cumsum(counts) - counts)[has])
            halves.append(total)
        yield Sets(w, grams, counts, (halves[0], halves[1]))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("h").to_numpy(zero_copy_only=False)
        parts = [(s.counts, np.stack(s.halves, axis=1), s.marks(ids)) for s in sets(batch.column("text"))]
        counts, halves, marks = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, np.uint64))
        fp = pa.array([x.tobytes() for x in halves], pa.binary(), mask=counts == 0)
        yield pa.RecordBatch.from_arrays([batch.column("id"), fp, pa.array(counts), pa.array(marks.view(np.int64))], ["id", "fp", "n", "mark"])


def _chosen(marks: Bitmap, batch: pa.RecordBatch) -> Iterator[tuple[Sets, np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of a batch with the texts of which each is the one of its kind (or seems to be), and their signatures."""
    ids = batch.column("h").to_numpy(zero_copy_only=False)
    for s in sets(batch.column("text")):
        own = np.flatnonzero((s.counts > 0) & marks.has(s.marks(ids)))
        picked = np.zeros(len(s.counts), bool)
        picked[own] = True
        keys, text = signatures(s.hashes[np.repeat(picked, s.counts)], s.counts[own])
        yield s, own, keys, text


def has_all(bitmap: Bitmap, keys: np.ndarray) -> np.ndarray:
    """Whether the keys seem to be in a bitmap of all their rotations."""
    out = bitmap.has(keys)
    for turn in TURNS[1:]:
        out &= bitmap.has((keys >> np.uint64(turn)) | (keys << np.uint64(64 - turn)))
    return out


def turned(keys: DataFrame) -> DataFrame:
    """(h): the rotations of the keys."""
    key = F.col("key")
    return keys.select(F.explode(F.array(key, *(F.shiftrightunsigned(key, t).bitwiseOR(F.shiftleft(key, 64 - t)) for t in TURNS[1:]))).alias("h"))


def parities(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (longs end to end, and how many each text has) whose bits are the parities of hashed shingles: two of one
    length differ in at most as many bits as their sets.  A sketch has a bit for each shingle, rounded up to a power of
    two; the halves of one, put together by exclusive or, are the sketch of half as many bits."""
    bits = 1 << np.ceil(np.log2(np.maximum(counts, LEAST_BITS))).astype(np.int64)
    first = np.cumsum(bits) - bits
    at = np.repeat(first, counts) + (hashes & (np.repeat(bits, counts) - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), bits >> 6


def _list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def bucket_bits(shingles: int) -> int:
    """Bits of a bucket's number, for so many shingles."""
    return min(24, (shingles // BUCKET_SHINGLES).bit_length())


def shortened(keys: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of the first 32 + bits bits of signatures, by which they are counted."""
    return W.mix(keys >> np.uint64(32 - bits))


def _buckets(marks, bits: int):
    """(bucket, rest) of the signatures: their first bits, and the next 32 of all in the bucket, at most twice for each."""

    def filled(some: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(some) >> np.uint64(32 - bits))
        again = np.zeros(len(keys), bool)
        again[2:] = keys[2:] == keys[:-2]
        keys = keys[~again]
        bucket, first = np.unique((keys >> np.uint64(32)).astype(np.int32), return_index=True)
        offsets = np.append(first, len(keys)) * 4
        rest = keys.astype(np.uint32)
        binary = pa.Array.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rest)])
        return pa.RecordBatch.from_arrays([pa.array(bucket), binary], ["bucket", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for _, _, keys, _ in _chosen(marks.value, batch):
                some.append(keys)
                n += len(keys)
                if n >= HELD:
                    yield filled(some)
                    some, n = [np.zeros(0, np.uint64)], 0
        yield filled(some)

    return run


def _repeated(bits: int):
    """The shortened signatures that are in a bucket twice or more."""

    def run(table: pa.Table) -> pa.Table:
        rest = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("rest").combine_chunks()]))
        rest = np.unique(rest[1:][rest[1:] == rest[:-1]])
        bucket = np.uint64(table.column("bucket")[0].as_py())
        return pa.table({"key": W.mix((bucket << np.uint64(32)) | rest.astype(np.uint64)).view(np.int64)})

    return run


def _likely(marks, crowded, bits: int):
    """Texts with signatures that others seem to have too, those signatures, and the text's words as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, own, keys, text in _chosen(marks.value, batch):
                some = has_all(crowded.value, shortened(keys, bits))
                keys, text = keys[some], text[some]
                order = np.argsort(text, kind="stable")
                n_keys = np.bincount(text, minlength=len(own))
                own, n_keys = own[n_keys > 0], n_keys[n_keys > 0]
                fp = pa.array([x.tobytes() for x in np.stack(s.halves, axis=1)[own]], pa.binary())
                n_words = s.words.counts()[own]
                picked = np.zeros(len(s.counts), bool)
                picked[own] = True
                words = s.words.hashes[np.repeat(picked, s.words.counts())].astype(np.uint32).view(np.int32)
                odd = parities(s.hashes[np.repeat(picked, s.counts)], s.counts[own])
                columns = [fp, pa.array(s.counts[own]), _list(keys[order].view(np.int64), n_keys), _list(*odd), _list(words, n_words)]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "n", "keys", "odd", "words"])

    return run


def word_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of an int32 array of words."""
    size = min(SHINGLE, len(words))
    x = words.view(np.uint32).astype(np.uint64)
    out = np.full(len(x) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = W.mix(out * np.uint64(0x9FB21C651E98DF25) + x[j : len(x) - size + 1 + j])
    return np.unique(out)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (small + large - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("words"), batch.column("words_c")
        keep = [linked(*(word_set(v[i].values.to_numpy(zero_copy_only=False)) for v in (a, b))) for i in range(batch.num_rows)]
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column("fp"), out.column("c")], ["fp", "c"])


@dataclass
class Pack:
    """Groups (key, i, j) of members in order of their blocks, one behind the other."""

    table: pa.Table
    n: np.ndarray
    label: np.ndarray
    block: np.ndarray
    end: np.ndarray
    whole: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Pack:
        table = table.sort_by([(c, "ascending") for c in ("key", "i", "j", "block", "fp")]).combine_chunks()
        key, i, j, block, n, root = (table.column(c).to_numpy() for c in ("key", "i", "j", "block", "n", "root"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first = np.flatnonzero(new)
        return Pack(table, n, np.unique(root, return_inverse=True)[1], block, np.append(first[1:], len(key))[np.cumsum(new) - 1], i == j)

    def lists(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The values of a column of lists, end to end, and where each begins."""
        column = self.table.column(name).combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.values.to_numpy(), column.offsets.to_numpy()

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The members of a group (of two blocks of it, if these are two) that are of different classes, as these are when the
        pairs are asked for, and could link by the sizes and the sketches."""
        values, offsets = self.lists("odd")
        sketches = Sketches(values.view(np.uint64), offsets)
        a = np.arange(len(self.n))
        for step in range(1, len(self.n)):
            a = a[a + step < self.end[a]]
            if not len(a):
                return
            x, y = a, a + step
            for some in (
                lambda x, y: self.label[x] != self.label[y],
                lambda x, y: self.whole[x] | (self.block[x] != self.block[y]),
                lambda x, y: 100 * np.minimum(self.n[x], self.n[y]) >= PERCENT * np.maximum(self.n[x], self.n[y]),
                lambda x, y: sketches.differ(x, y) <= most_apart(self.n[x] + self.n[y]),
            ):
                passed = some(x, y)
                x, y = x[passed], y[passed]
            if len(x):
                yield x, y


class Sketches:
    """Sketches end to end, compared two by two; of two lengths, one is twice the other."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.lengths = np.diff(offsets)
        self.tables = {}
        for length in np.unique(self.lengths).tolist():
            own, more = (np.flatnonzero(self.lengths == x) for x in (length, 2 * length))
            rows, halves = values[offsets[own][:, None] + np.arange(length)], values[offsets[more][:, None] + np.arange(2 * length)]
            at = np.zeros(len(self.lengths), np.int64)
            at[own], at[more] = np.arange(len(own)), np.arange(len(more)) + len(own)
            self.tables[length] = at, np.concatenate([rows, halves[:, :length] ^ halves[:, length:]])

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of each pair differ."""
        out, length = np.zeros(len(x), np.int64), np.minimum(self.lengths[x], self.lengths[y])
        for own in np.unique(length).tolist():
            at, rows = self.tables[own]
            some = np.flatnonzero(length == own)
            out[some] = np.bitwise_count(rows[at[x[some]]] ^ rows[at[y[some]]]).sum(axis=1, dtype=np.int64)
        return out


def near(table: pa.Table) -> pa.Table:
    """The members of a pack of groups that could link with one of another class."""
    pack = Pack.of(table)
    wanted = np.zeros(len(pack.n), bool)
    for x, y in pack.pairs():
        wanted[x] = wanted[y] = True
    return pack.table.filter(pa.array(wanted)).drop_columns(["pack"])


def settle(table: pa.Table) -> pa.Table:
    """Links between the classes of the groups of a pack."""
    pack = Pack.of(table)
    values, offsets = pack.lists("words")
    fp, label = pack.table.column("fp").to_numpy(), pack.label
    own: dict[int, np.ndarray] = {}
    links = []
    for x, y in pack.pairs():
        for pair in zip(x.tolist(), y.tolist(), strict=True):
            a, b = pair
            if label[a] == label[b]:
                continue
            for k in pair:
                if fp[k] not in own:
                    own[fp[k]] = word_set(values[offsets[k] : offsets[k + 1]])
            if linked(own[fp[a]], own[fp[b]]):
                links.append(pair)
                label[label == label[b]] = label[a]
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"fp": fp[a], "c": fp[b]})


def packed(groups: DataFrame, n_bytes: Column) -> DataFrame:
    """The groups (key, i, j, ...) dealt to packs, each worked on at once."""
    total = groups.agg(F.coalesce(F.sum(n_bytes), F.lit(0))).first()[0]
    return groups.withColumn("pack", F.pmod(F.xxhash64("key", "i", "j"), F.lit(1 + int(total) // PACK_BYTES)))


def settled(members: DataFrame, likely: DataFrame, space: Workspace) -> DataFrame:
    """Links (fp, c) between classes that share a signature, of members (key, fp, n, root).

    Signatures of the same members are settled once.  Only members that sizes and sketches let pass bring their words."""
    members = space.save(members, "members")
    same = [F.bit_xor(F.xxhash64(F.lit(k), "fp")).alias(f"x{k}") for k in (1, 2)]
    about = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("fp").alias("x"), F.max("fp").alias("y"), F.count("*").alias("m"), F.sum("n").alias("all_n"), *same)
    mixed = about.where("a != b").groupBy("m", "all_n", "x", "y", "x1", "x2").agg(F.min("key").alias("key"))
    mixed = space.save(mixed, "mixed")
    parts = F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("all_n") / BLOCK_SHINGLES)).cast("int")
    own = salted_join(members, mixed.select("key", parts.alias("parts")), "key", F.col("fp"), counts=mixed.select("key", F.col("m").alias("n")))
    own = own.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = space.save(own.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "root", "n"), "own")
    row = "key long, i int, j int, block int, fp long, root long, n long, odd array<long>"
    own = packed(own, F.greatest("n", F.lit(LEAST_BITS)) / 8 + 64)
    own = salted_join(own, likely.select(F.col("t").alias("fp"), "odd"), "fp", F.struct("key", "i", "j"))
    close = space.save(own.select("key", "i", "j", "block", "fp", "root", "n", "odd", "pack").groupBy("pack").applyInArrow(near, row), "close")
    # most signatures of a family leave the same members
    group = close.groupBy("key", "i", "j").agg(F.count("*").alias("m"), F.min("fp").alias("x"), F.max("fp").alias("y"), *same)
    group = group.groupBy("m", "x", "y", "x1", "x2").agg(F.min(F.struct("key", "i", "j")).alias("g"), F.max("m").alias("n")).select("g.*", "n")
    close = salted_join(close.withColumn("g", F.xxhash64("key", "i", "j")), group.select(F.xxhash64("key", "i", "j").alias("g")), "g", F.col("fp"), counts=group.select(F.xxhash64("key", "i", "j").alias("g"), "n"))
    close = space.save(close.drop("g"), "groups")
    full = salted_join(packed(close, 5 * F.col("n") + 256), held(likely, close.select("fp")), "fp", F.struct("key", "i", "j"))
    return full.groupBy("pack").applyInArrow(settle, "fp long, c long")


def _wanted(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bitmap.value.has(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))))
            yield batch.select(["fp", "words"])

    return run


def held(likely: DataFrame, some: DataFrame) -> DataFrame:
    """(fp, words) of the texts (fp) and perhaps of others."""
    bitmap = some.sparkSession.sparkContext.broadcast(membership(some.distinct(), F.xxhash64("fp")))
    return likely.select(F.col("t").alias("fp"), "words", F.xxhash64("t").alias("h")).transform(W.mapped, _wanted(bitmap), "fp long, words array<int>")


def halved(sketch: str, other: str) -> Column:
    """The sketch with its halves put together if it is longer than the other."""
    half = (F.size(sketch) / 2).cast("int")
    return F.when(F.size(sketch) > F.size(other), F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(sketch))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    space = Workspace(spark, "ngram-join")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", F.xxhash64("id"))
    id_type = own.schema["id"].dataType.simpleString()
    rows = space.save(own.transform(W.mapped, _fingerprints, f"id {id_type}, fp binary, n long, mark long"), "rows")
    texts = space.save(rows.where("fp is not null").groupBy("fp").agg(F.min("mark").alias("mark"), F.min("id").alias("first_id"), F.count("*").alias("copies")), "texts")
    marks = spark.sparkContext.broadcast(membership(texts, F.col("mark")))
    # one of each kind of text gives its signatures
    bits = bucket_bits(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    buckets = own.where("text is not null").select("h", "text").transform(W.mapped, _buckets(marks, bits), "bucket int, rest binary")
    crowded = space.save(buckets.groupBy("bucket").applyInArrow(_repeated(bits), "key long"), "crowded")
    bitmap = spark.sparkContext.broadcast(membership(turned(crowded), F.col("h")))
    likely = own.where("text is not null").select("h", "text").transform(W.mapped, _likely(marks, bitmap, bits), "fp binary, n long, keys array<long>, odd array<long>, words array<int>")
    likely = likely.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("n", "keys", "odd", "words")))
    # a number for each text; the table is written once and read from then on
    likely = space.save(likely.withColumn("t", F.monotonically_increasing_id()), "likely")
    each = likely.select(F.col("t").alias("fp"), "n", F.explode("keys").alias("key"))
    about = space.save(each.groupBy("key").agg(F.min("fp").alias("c"), F.max("fp").alias("d"), F.count("*").alias("m")).where("c != d"), "about")
    shared = space.save(salted_join(each, about.select("key", "c"), "key", F.col("fp"), counts=about.select("key", F.col("m").alias("n"))), "shared")
    pairs = space.save(shared.where("fp != c").groupBy("fp", "c").agg(F.count("*").alias("n")), "pairs")
    best = pairs.groupBy("fp").agg(F.max(F.struct("n", "c")).alias("best")).select("fp", F.col("best.c").alias("c"))

    def verified(some: DataFrame) -> DataFrame:
        words = held(likely, some.select("fp").union(some.select("c")))
        full = salted_join(some.join(words, "fp"), words.select(F.col("fp").alias("c"), F.col("words").alias("words_c")), "c", F.col("fp"), counts=some.groupBy("c").agg(F.count("*").alias("n")))
        return full.transform(W.mapped, _verify, "fp long, c long")

    def alike(some: DataFrame, placed: DataFrame) -> DataFrame:
        """The pairs (fp, c) that are of different classes and that sizes and sketches let pass, by texts (fp, n, odd, root)."""
        centre = placed.select(F.col("fp").alias("c"), F.col("n").alias("n_c"), F.col("odd").alias("odd_c"), F.col("root").alias("root_c"))
        both = salted_join(some.join(placed, "fp"), centre, "c", F.col("fp"), counts=some.groupBy("c").agg(F.count("*").alias("n")))
        # sets of such sizes have sketches of one length, or of twice the other's
        differ = F.aggregate(F.zip_with(halved("odd", "odd_c"), halved("odd_c", "odd"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
        sizes = 100 * F.least("n", "n_c") >= PERCENT * F.greatest("n", "n_c")
        return both.where((F.col("root") != F.col("root_c")) & sizes & (differ <= F.floor(F.lit(100 - PERCENT) * (F.col("n") + F.col("n_c")) / (100 + PERCENT)))).select("fp", "c")

    def rooted(some: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """(node, root) by the links, where a root is a node as well."""
        roots = connected_components(links.select(F.col("fp").alias("a"), F.col("c").alias("b")), space, name)
        return some.join(roots, some["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))

    # the most frequent centre of each text first, then all others of other classes, as far as sizes and sketches let pass
    best = space.save(best, "best")
    about_texts = likely.select(F.col("t").alias("fp"), "n", "odd")
    links = space.save(verified(space.save(alike(best, about_texts.withColumn("root", F.col("fp"))), "likeliest")), "links")
    roots = space.save(rooted(about_texts.select("fp"), links, "first"), "roots")
    rest = pairs.select("fp", "c").join(best, ["fp", "c"], "left_anti")
    rest = space.save(alike(rest, about_texts.join(roots, "fp")), "rest")
    links = links.union(space.save(verified(rest), "more"))
    roots = space.save(rooted(about_texts.select("fp"), links, "second"), "roots-2")
    members = salted_join(shared.select("key", "fp", "n"), roots, "fp", F.col("key"))
    links = links.union(space.save(settled(members, likely, space), "settled"))
    roots = connected_components(links.select(F.col("fp").alias("a"), F.col("c").alias("b")), space, "all")
    named = likely.select("fp", "t").join(roots.withColumnRenamed("node", "t"), "t", "left").select("fp", F.coalesce("root", "t").alias("root"))
    whole = texts.join(named, "fp", "left")
    classes = whole.where("root is not null").groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n"))
    classes = space.save(classes, "classes")
    with_class = salted_join(whole, classes.select("root", "class_id"), "root", F.col("fp"), "left", classes.select("root", "n"))
    final = space.save(with_class.select("fp", F.coalesce("class_id", "first_id").alias("component_id"), "copies"), "final")
    space.keep("rows", "final")
    out = salted_join(rows.select("id", "fp", "n"), final.select("fp", "component_id"), "fp", F.xxhash64("id"), "left", final.select("fp", F.col("copies").alias("n")))
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: All pairs that share a shingle, and what can be reached from each document.
OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT min(doc_id) AS t, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
g AS MATERIALIZED (SELECT DISTINCT t, array_to_string(list_slice(w, i, i + least({SHINGLE}, len(w)) - 1), ' ') AS g FROM t, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) s(i) WHERE len(w) > 0),
n AS (SELECT t, count(*) AS n FROM g GROUP BY t),
p AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.t < b.t GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT t, t AS r FROM n UNION SELECT b, r FROM reach JOIN both_ways ON a = reach.t),
m AS (SELECT t, min(r) AS c FROM reach GROUP BY t)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN n USING (t) LEFT JOIN m USING (t)
"""
