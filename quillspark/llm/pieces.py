"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces of a model span a lattice over the text (a space is written U+2581).  A piece of id i has weight
1 / rank(i)^alpha, rank counting from the first piece after the byte pieces.  Forward filtering sums the weights of all
segmentations of each prefix; backward sampling then draws, from the end of the text, each piece in proportion to the
segmentations that end in it.  The draws are a hash of the seed, the row's key and the place, so that a row has the
same segmentation wherever and whenever it is encoded.  A character that no piece holds becomes its UTF-8 byte pieces,
as does a literal U+2581, which makes decoding lossless.

No piece crosses from a character to a following space (checked when a model is read), so the lattice of a text is a
chain of the lattices of its units: spaces with what follows them up to the next space, and single control characters,
if no longer piece holds them.  Equal units of a chunk of text share one lattice; each occurrence draws on its own.

Defined results: a null text has null pieces; an empty one none; repeated rows (same key and text) have equal pieces;
very long texts and units are encoded whole; columns of the rows that clash with an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _words as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 1234
SPACE = 0x2581
NO_CHAR = 0x110000
#: A worker holds about 100 bytes for each byte of a chunk, next to an executor's full heap.
CHUNK = 1 << 20
ADDED = ("n_pieces", "pieces", "lossless")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Vocabulary:
    """Pieces by length in characters: sorted hashes, ids (-1: only the beginning of a longer piece), and their bytes."""

    hashes: list[np.ndarray]
    slots: list[np.ndarray]
    ids: list[np.ndarray]
    log_weight: np.ndarray
    byte_id: np.ndarray
    data: np.ndarray
    at: np.ndarray
    alone: np.ndarray

    @staticmethod
    def read(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_id = np.full(256, -1, np.int64)
        raw: list[bytes] = []
        tables: dict[int, dict[int, int]] = {}
        first = 0
        alone = np.arange(256) < 32
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
                first = i
                continue
            if model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
                continue
            if "▁" in piece.lstrip("▁") or " " in piece:
                raise ValueError(f"piece {i} crosses a unit")
            if len(piece) > 1:
                alone[[ord(c) for c in piece if ord(c) < 32]] = False
            raw.append(piece.replace("▁", " ").encode())
            h = np.zeros(1, np.uint64)
            for n, c in enumerate(piece, 1):
                h = _extend(h, np.array([ord(c)], np.uint64))
                tables.setdefault(n, {}).setdefault(int(h[0]), -1)
            tables[len(piece)][int(h[0])] = i
        if (byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        hashes, slots, ids = [], [], []
        for n in range(1, max(tables) + 1):
            keys = np.array(sorted(tables[n]), dtype=np.uint64)
            hashes.append(keys)
            slots.append(np.searchsorted(keys >> np.uint64(48), np.arange(1 << 16, dtype=np.uint64)).astype(np.int32))
            ids.append(np.array([tables[n][int(k)] for k in keys], dtype=np.int64))
        rank = np.maximum(np.arange(size) - first, 1)
        return Vocabulary(hashes, slots, ids, -alpha * np.log(rank), byte_id, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), alone)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the pieces laid end to end, and where each begins (one more at the end)."""
        sizes = self.at[ids + 1] - self.at[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.data[np.repeat(self.at[ids] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return W.mix(h * np.uint64(0xD6E8FEB86659FD93) + code + np.uint64(1))


def find(keys: np.ndarray, slots: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash is in the sorted keys, and whether it is: a search from the first key with its upper 16 bits."""
    last = len(keys) - 1
    place = np.minimum(slots[(h >> np.uint64(48)).astype(np.int64)].astype(np.int64), last)
    got = keys[place]
    behind = np.flatnonzero((got < h) & (place < last))
    while len(behind):
        place[behind] += 1
        got[behind] = keys[place[behind]]
        behind = behind[(got[behind] < h[behind]) & (place[behind] < last)]
    return place, got == h


@dataclass
class Lattice:
    """Lattices of distinct units.  Node ``base[u] + i`` is before character i of unit u; edges are ordered by the node
    they end in, longest first; ``first`` is each node's first edge and ``upper`` the cumulated chance of its edges."""

    base: np.ndarray
    size: np.ndarray
    first: np.ndarray
    upper: np.ndarray
    source: np.ndarray
    piece: np.ndarray


def build(v: Vocabulary, codes: np.ndarray, sizes: np.ndarray) -> Lattice:
    """The lattices of units given as code points laid end to end."""
    n = len(codes)
    # places in half the bytes, if all edges (one more a character than there are lengths) can be counted so
    small = np.int32 if n < 1 << 26 else np.int64
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(small)
    unit = np.repeat(np.arange(len(sizes), dtype=small), sizes)
    left = np.repeat((first + sizes).astype(small), sizes) - np.arange(n, dtype=small)
    end, node, piece = [], [], []
    at, h = np.arange(n, dtype=small), np.zeros(n, np.uint64)

    def add(chars: np.ndarray, k: int, ids: np.ndarray) -> None:
        node.append(chars + unit[chars])
        end.append(node[-1] + small(k))
        piece.append(ids.astype(np.int32))

    # longest pieces first among the edges of a node: the lists are put together backwards
    for k, (keys, slots, ids) in enumerate(zip(v.hashes, v.slots, v.ids, strict=True), 1):
        more = left[at] >= k
        at, h = at[more], _extend(h[more], codes[at[more] + k - 1].astype(np.uint64))
        place, known = find(keys, slots, h)
        if k == 1:
            single = np.zeros(n, bool)
            single[at[known & (ids[place] >= 0)]] = True
            lone = np.flatnonzero(~single).astype(small)
            add(lone, 1, np.full(len(lone), -1))
            del single, lone
        at, h, place = at[known], h[known], place[known]
        whole = ids[place] >= 0
        add(at[whole], k, ids[place[whole]])
        if not len(at):
            break
    del at, h, place, known, whole, left
    # nodes: one more than characters in each unit
    base = first + np.arange(len(sizes), dtype=small)
    forward = np.full(n + len(sizes), -np.inf)
    forward[base] = 0.0
    end, node, piece = np.concatenate(end[::-1]), np.concatenate(node[::-1]), np.concatenate(piece[::-1])
    order = np.argsort(end, kind="stable")
    end, node, piece = end[order], node[order], piece[order]
    del order, unit
    if not len(end):
        return Lattice(base, np.asarray(sizes, small), np.zeros(len(forward), small), np.zeros(0), node, piece)
    # forward filtering: all edges that end k characters into their unit, for k = 1, 2, ...
    depth = (np.arange(len(forward), dtype=small) - np.repeat(base, sizes + 1))[end]
    depth = depth.astype(np.uint16) if depth.max() < 1 << 16 else depth
    order = np.argsort(depth, kind="stable").astype(small)
    stops = np.concatenate([[0], np.flatnonzero(np.diff(depth[order])) + 1, [len(order)]]).tolist()
    del depth
    share = np.empty(len(node))
    for a, b in zip(stops[:-1], stops[1:], strict=True):
        at = order[a:b]
        into = end[at]
        own = piece[at]
        value = forward[node[at]] + np.where(own < 0, 0.0, v.log_weight[np.maximum(own, 0)])
        heads = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
        counts = np.diff(np.append(heads, b - a))
        top = np.maximum.reduceat(value, heads)
        part = np.exp(value - np.repeat(top, counts))
        total = np.add.reduceat(part, heads)
        forward[into[heads]] = top + np.log(total)
        share[at] = part / np.repeat(total, counts)
    del order
    heads = np.concatenate([[True], end[1:] != end[:-1]])
    upper = np.cumsum(share)
    before = np.subtract(upper, share, out=share)
    before[~heads] = -1.0
    upper -= np.maximum.accumulate(before, out=before)
    upper[np.append(heads[1:], True)] = 2.0
    nodes_first = np.zeros(len(forward), small)
    nodes_first[end[heads]] = np.flatnonzero(heads)
    return Lattice(base, np.asarray(sizes, small), nodes_first, upper, node, piece)


def sample(x: Lattice, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges drawn for occurrences of units, in text order, and the occurrence of each."""
    at = x.base[unit] + x.size[unit]
    who = np.flatnonzero(x.size[unit] > 0).astype(at.dtype)
    found, owner, steps = [], [], []
    step = 0
    while len(who):
        bits = W.mix(key[who] + np.full(1, step, np.uint64) * _STEP)
        chance = (bits >> np.uint64(12)).astype(np.float64) / float(1 << 52)
        edge = x.first[at[who]]
        more = np.flatnonzero(x.upper[edge] <= chance)
        while len(more):
            edge[more] += 1
            more = more[x.upper[edge[more]] <= chance[more]]
        found.append(edge)
        owner.append(who)
        steps.append(np.full(len(who), step, at.dtype))
        at[who] = x.source[edge]
        who = who[at[who] > x.base[unit[who]]]
        step += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge, owner, steps = np.concatenate(found), np.concatenate(owner), np.concatenate(steps)
    del found
    counts = np.bincount(owner, minlength=len(unit))
    out = np.empty(len(edge), edge.dtype)
    ends = np.cumsum(counts)
    place = ends[owner] - 1 - steps
    out[place] = edge
    return out, np.repeat(np.arange(len(unit)), counts)


def encode_chunk(v: Vocabulary, data: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the documents of a chunk laid end to end, and the number of each document's."""
    n, docs = len(data), len(at) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(docs, np.int64)
    space, control = data == 32, v.alone[data]
    start = control.copy()
    start[1:] |= control[:-1] | (space[1:] & ~space[:-1])
    start[at[:-1][at[:-1] < n]] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    up, down = W.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    sums[1:] = data
    sums[1:] += np.uint64(1)
    sums[1:] *= up[:n]
    np.cumsum(sums, out=sums)
    name = W.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    del sums, space, control, start
    _, where, unit = np.unique(name, return_index=True, return_inverse=True)
    # the distinct units' bytes, then code points
    b, e = begin[where], end[where]
    sizes = e - b
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    own = data[np.repeat(b - offsets[:-1], sizes) + np.arange(offsets[-1])]
    chars = (own & 0xC0) != 0x80
    codes = np.frombuffer(own.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    count = np.add.reduceat(chars.astype(np.int64), offsets[:-1])
    lone = codes.copy()
    codes = np.where(codes == SPACE, NO_CHAR, np.where(codes == 32, SPACE, codes))
    x = build(v, codes, count)
    doc = np.searchsorted(at, begin, "right") - 1
    first = np.searchsorted(begin, at[:-1])
    key = W.mix(keys[doc] + (np.arange(len(begin)) - first[doc]).astype(np.uint64) * _UNIT)
    edge, owner = sample(x, unit, key)
    piece = x.piece[edge]
    missing = piece < 0
    # a character without a piece: the node number less the unit's is its place among all code points
    code = lone[np.maximum(x.source[edge] - unit[owner], 0)]
    width = np.where(missing, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
    ids = np.repeat(piece, width)
    if missing.any():
        ends = np.cumsum(width)
        spot = np.repeat(ends[missing] - width[missing], width[missing])
        inner = np.arange(len(spot)) - np.repeat(np.cumsum(width[missing]) - width[missing], width[missing])
        text = "".join(map(chr, code[missing].tolist())).encode("utf-8")
        ids[spot + inner] = v.byte_id[np.frombuffer(text, np.uint8)]
    return ids, np.bincount(np.repeat(doc[owner], width), minlength=docs)


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The documents with n_pieces, pieces (ids) and lossless (whether decoding them gives the text again)."""
    columns = [c for c in docs.columns if c not in ADDED]
    own = docs.select(*(F.col(f"`{c}`") for c in columns), F.xxhash64(F.lit(seed), F.col(f"`{key_col}`")).alias("__h"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model, alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            raw, offsets = W.text_buffers(text)
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi in W.chunks(offsets, CHUNK):
                data, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ids, counts = encode_chunk(v, data, at, keys[lo:hi])
                stops = np.concatenate([[0], np.cumsum(counts)])
                back, ends = v.decode(ids)
                same = len(back) == len(data) and np.array_equal(back, data) and np.array_equal(ends[stops], at)
                fine = np.full(hi - lo, True) if same else np.array([back[ends[stops[i]] : ends[stops[i + 1]]].tobytes() == data[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)], bool)
                null = np.asarray(text.slice(lo, hi - lo).is_null())
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts), lists, pa.array(fine)], [*columns, *ADDED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.transform(W.mapped, run, f"{schema}, n_pieces long, pieces array<int>, lossless boolean".lstrip(", "))


def decode(rows: DataFrame, pieces_col: str = "pieces", out: str = "text", model: str = MODEL) -> DataFrame:
    """The rows with the text of their pieces; a null list is a null text, null ids and ids that the vocabulary does not
    have are left out, and bytes that are no UTF-8 become U+FFFD."""
    columns = [c for c in rows.columns if c != out]
    own = rows.select(*(F.col(f"`{c}`") for c in columns))
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(pieces_col))
            ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (ids >= 0) & (ids < len(shared.value.at) - 1)
            stops = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            stops = np.concatenate([[0], np.cumsum(known)])[stops]
            back, ends = shared.value.decode(ids[known])
            texts = [None if null else back[ends[a] : ends[b]].tobytes().decode("utf-8", "replace") for a, b, null in zip(stops[:-1], stops[1:], column.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.transform(W.mapped, run, f"{schema}, `{out}` string")


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", *ADDED)
