"""Language-model scoring by an Elias-Fano n-gram trie of order 3.

Counts come from all training documents. Level 1 is the vocabulary, cut by hash into pieces: sorted 64-bit word hashes
(a word's id is its rank), exact counts, and the number T of distinct followers. Levels 2 and 3 are cut into shards by a
hash of the first two words, so that a frequent first word spreads out; a frequent pair's rows are added up as they come,
so that a building task holds the distinct followers and not their repeats. In a shard children are kept relative to their
context (rank of the context times the universe, plus the child's id) as one Elias-Fano sequence per level. Monotone
pointers, also Elias-Fano, delimit the children of each context; a query reads a context's range from them and looks for
the successor of the child's id within it, in the bucket of its upper bits. Values are 8-bit codes. All files are
memory-mapped from the shared folder and opened when first asked for, so a scoring task holds what it touches, whatever the
model's size, and a lost executor loses nothing.

Smoothing (Witten-Bell, interpolated): p(w|uv) = c(uvw) / (c(uv) + T(uv)) + T(uv) / (c(uv) + T(uv)) * p(w|v), and alike
for p(w|v); p(w) = (c - D) / N, with D = n1 / (n1 + 2 n2) from the words seen once and twice (1/2 where either is
missing), and the mass D * V / N for the unknown word. Levels 2 and 3 store the codes of the first fractions, level 3 also
that of its contexts' second; level 2's second comes from the exact counts of level 1. Quantising keeps each within 2 % or so.

Limits: a pair of ids must fit 63 bits, which is checked (3e9 types); words are told apart by 64-bit hashes, of which two
among 3e9 types are equal with a chance of one in eight.

Defined results: a null or empty text is the end token only; words unseen in training share one type; a first token is
scored without context. Without training documents score is null and base_score 0 by its formula's limit. Null ids
teach nothing and aren't held out; repeated rows count as often as they stand. Only doc_id and text are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import is_held_out, remainder
from ._shared import arrow_columns, materialise, open_map, shared_dir, ship, write_bytes

#: Bytes of texts whose n-grams are aggregated before the shuffle at once, and tokens per shard of the trie and piece of
#: the vocabulary.
CHUNK_BYTES = 4_500_000
SHARD_TOKENS = 2_000_000
COUNTED_WORDS = 800_000
COUNTED_CHARS = 2_000_000
#: N-gram rows of a shard that wait for being added up.
WAITING = 4_000_000
#: Shards, and pieces of the vocabulary, that a process keeps open: maps of two files each, of which a process may have 65,530.
#: Shards of a million tokens reach this at about 50 GB of text, pieces never do.
MOST_OPEN = 8_192
SCORE_ROWS = 1024
ALPHA = 0.1


def tokenised(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, their places in that list for all words in order, how many words each text has) of an Arrow array
    of texts. A-Z become lower; white space is the six ASCII characters."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    there = pc.binary_length(flat).to_numpy() > 0  # white space at a text's ends leaves empty strings
    if not there.all():
        ends = np.concatenate([[0], np.cumsum(there)])[ends]
        flat = flat.filter(pa.array(there))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), np.diff(ends)


# --- files: named arrays that are read without copying


def pack(arrays: dict[str, np.ndarray]) -> list[bytes]:
    head, at, parts = {}, 0, []
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % 64)
        head[k] = [str(a.dtype), len(a), at]
        at += len(raw)
        parts.append(raw)
    said = json.dumps(head).encode()
    said += b" " * (-(len(said) + 8) % 64)
    return [len(said).to_bytes(8, "little"), said, *parts]


def mapped(uri: str) -> dict[str, np.ndarray]:
    buffer = open_map(uri)
    n = int.from_bytes(buffer[:8].to_pybytes(), "little")
    head = json.loads(buffer[8 : 8 + n].to_pybytes())
    return {k: np.frombuffer(buffer, dtype=kind, count=size, offset=8 + n + at) for k, (kind, size, at) in head.items()}


# --- Elias-Fano


def ef_pack(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence: low bits side by side, upper bits in unary with counts of ones per word."""
    n = len(values)
    low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
    v = values.astype(np.uint64)
    low = np.zeros(0, dtype=np.uint8)
    if low_bits and n:
        parts = []
        for a in range(0, n, 1 << 16):  # a multiple of 8 values fills whole bytes
            x = v[a : a + (1 << 16)] & np.uint64((1 << low_bits) - 1)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
            parts.append(np.packbits(bits.ravel(), bitorder="little"))
        low = np.concatenate(parts)
    ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    size = (universe >> low_bits) + n + 1
    high = np.zeros(-(-size // 64) * 8, dtype=np.uint8)
    np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    words = high.view(np.uint64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    return {f"{name}.low": np.concatenate([low, np.zeros(8, dtype=np.uint8)]), f"{name}.high": words, f"{name}.before": before, f"{name}.shape": np.array([n, low_bits], dtype=np.int64)}


_ONES = np.uint64(0x0101010101010101)
#: [number of set bits to skip, byte] -> place of the next set bit
_PLACES = np.array([[([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256)] for k in range(8)], dtype=np.int64).ravel()


def _in_word(w: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places of the left-th set bits (from 0) of the words w: the byte by cumulated counts of ones, then a table."""
    s = w - ((w >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte i: ones up to its end
    k = left.astype(np.uint64)
    # a byte's top bit stays where its ones are more than k
    full = ((k | np.uint64(0x80)) * _ONES - s) & np.uint64(0x8080808080808080)
    shift = (np.bitwise_count(full).astype(np.uint64)) << np.uint64(3)
    before = (s << np.uint64(8)) >> shift & np.uint64(255)
    return shift.astype(np.int64) + _PLACES.take(((k - before) << np.uint64(8) | (w >> shift) & np.uint64(255)).view(np.int64))


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the k-th set bits (from 0) of words, whose set bits up to each word are in before."""
    at = np.searchsorted(before, k, side="right") - 1
    return at * 64 + _in_word(words.take(at), k - before.take(at))


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = arrays[f"{name}.shape"].tolist()
        low = arrays[f"{name}.low"]
        self.low = np.ndarray(shape=(max(0, len(low) - 7),), dtype="<u8", buffer=low, strides=(1,))
        self.high, self.before = arrays[f"{name}.high"], arrays[f"{name}.before"]
        self.zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        bit = i * self.low_bits
        x = self.low[bit >> 3] >> (bit & 7).astype(np.uint64)  # up to 57 bits are in reach of one load
        return (x & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((_select(self.high, self.before, i) - i) << self.low_bits) | self._low(i)

    def find(self, v: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | int = 1 << 62) -> np.ndarray:
        """The place of each value among those from low to high, -1 where it isn't: the successor within the bucket of
        its upper bits."""
        if not self.n:
            return np.full(len(v), -1, dtype=np.int64)
        h = v >> self.low_bits
        first = np.maximum(h - 1, 0)
        at = np.searchsorted(self.zeros, first, side="right") - 1
        bit = at * 64 + _in_word(~self.high.take(at), first - self.zeros.take(at)) + 1
        bit[h == 0] = 0
        start = bit - h
        # the bucket's values are the set bits from `bit` up to the next that isn't
        at, off = bit >> 6, (bit & 63).astype(np.uint64)
        ahead = (self.high.take(at) >> off) | (self.high.take(at + 1, mode="clip") << np.uint64(1) << (np.uint64(63) - off))
        size = np.bitwise_count(ahead ^ (ahead + np.uint64(1))).astype(np.int64) - 1
        if len(far := np.flatnonzero(size >= 62)):
            at = np.searchsorted(self.zeros, h[far], side="right") - 1
            size[far] = at * 64 + _in_word(~self.high.take(at), h[far] - self.zeros.take(at)) - bit[far]
        want = v & ((1 << self.low_bits) - 1)
        low = np.maximum(start, low)
        end = np.minimum(start + size, high)
        high = end.copy()
        live = np.flatnonzero(low + 1 < high)
        while len(live):  # buckets hold a value or two; binary search for those that hold more
            mid = (low[live] + high[live]) >> 1
            less = self._low(mid - 1) < want[live]
            low[live] = np.where(less, mid, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] + 1 < high[live]]
        hit = low < end
        return np.where(hit & (self._low(np.where(hit, low, 0)) == want), low, -1)


# --- codes


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-bit codes, values of the codes) of logarithms, in even steps between the least and the greatest."""
    a, b = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    book = np.linspace(a, b, 256)
    return np.rint((x - a) / ((b - a) / 255 or 1)).astype(np.uint8), book


# --- the vocabulary


def _kept_open(kept: dict, k: int, make):
    """kept[k], made if it isn't there. Each batch asks for nearly all, in the same order: once there are too many, those that
    are open stay open and only the others are opened anew."""
    if k in kept:
        return kept[k]
    x = make()
    if len(kept) < MOST_OPEN:
        kept[k] = x
    return x


class Vocabulary:
    """Ids, counts and followers of words. Pieces are opened when asked for."""

    def __init__(self, meta: dict, followers: bool = False):
        self.meta, self.with_followers = meta, followers
        self.opened: dict[int, tuple] = {}
        self.starts = np.concatenate([[0], np.cumsum(meta["sizes"])]).astype(np.int64)
        self.end, self.unknown, self.universe = int(self.starts[-1]), int(self.starts[-1]) + 1, int(self.starts[-1]) + 2
        if self.universe**2 >= 1 << 63:
            raise ValueError("more types than pairs of ids in 63 bits can tell apart")

    def piece(self, k: int) -> tuple:
        """(hashes, counts, followers) of a piece."""
        def open_piece() -> tuple:
            words = mapped(f"{self.meta['folder']}/vocab-{k}")
            return words["h"], words["c"], mapped(f"{self.meta['folder']}/followers-{k}")["t"] if self.with_followers else None

        return _kept_open(self.opened, k, open_piece)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, followers): first of the end of a text, then of words."""
        import xxhash

        h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        piece = (h >> np.uint64(64 - self.meta["bits"])).astype(np.int64) if self.meta["bits"] else np.zeros(len(h), dtype=np.int64)
        ids, counts, followers = np.full(len(h) + 1, self.unknown, dtype=np.int64), np.zeros(len(h) + 1, dtype=np.int64), np.zeros(len(h) + 1, dtype=np.int64)
        ids[0], counts[0] = self.end, self.meta["docs"]
        order = np.argsort(h)  # by piece, and in order within it
        for mine in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
            if len(mine) and self.meta["sizes"][k := int(piece[mine[0]])]:
                own, c, t = self.piece(k)
                at = np.minimum(np.searchsorted(own, h[mine]), len(own) - 1)
                hit = own.take(at) == h[mine]
                mine, at = mine[hit] + 1, at[hit]
                ids[mine], counts[mine] = self.starts[k] + at, c.take(at)
                if t is not None:
                    followers[mine] = t.take(at)
        return ids, counts, followers

    def counts_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, followers) of ids below the end, in ascending order."""
        counts, followers = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        piece = np.searchsorted(self.starts, ids, side="right") - 1
        for mine in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(piece)) + 1):
            if len(mine):
                _, c, t = self.piece(k := int(piece[mine[0]]))
                counts[mine], followers[mine] = c.take(ids[mine] - self.starts[k]), t.take(ids[mine] - self.starts[k])
        return counts, followers

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(places of all texts' words, each text followed by the end, which is place 0; where each text starts; the ids,
        counts and followers by place) of an Arrow array of texts"""
        words, at, sizes = tokenised(texts)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.zeros(starts[-1], dtype=np.int64)
        inner = np.ones(len(out), dtype=bool)
        inner[starts[1:] - 1] = False
        out[inner] = at + 1
        return out, starts, self.look_up(words)


def _pieces_of(keys: np.ndarray, values: np.ndarray, piece: np.ndarray):
    """Rows (piece, keys, values as bytes) of sorted keys."""
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)]):
        if b > a:
            yield int(piece[a]), keys[a:b].tobytes(), values[a:b].tobytes()


def _groups(batches):
    """(key, rows) of batches sorted by their first column."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _streams(batches):
    """(key, its rows without the key, one at a time) of batches sorted by their first column. A key's rows are to be
    taken before the next key."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for key, mine in groupby(rows, key=lambda r: r[0]):
        yield key, (r[1:] for r in mine)


def _in_turns(batches, most: int):
    """The first columns of batches, a few rows at a time: at most `most` bytes, or one text."""
    for batch in batches:
        column = batch.column(0)
        size = np.concatenate([[0], np.cumsum(_lengths(column))])
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(size, size[a] + most, side="right")) - 1)
            yield column.slice(a, b - a)
            a = b


def _lengths(texts) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _record(rows, names: list[str], kinds: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names) if rows else None


def _sum_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _vocabulary(train: DataFrame, folder: str, parts: int) -> dict:
    bits = max(0, (parts - 1).bit_length())

    def count(batches):
        import pyarrow as pa
        import xxhash

        def flush(counts):
            h, c = _sum_by_key(*map(np.concatenate, zip(*counts)))
            piece = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
            return _record(list(_pieces_of(h, c, piece)), ["piece", "h", "c"], [pa.int64(), pa.binary(), pa.binary()])

        counts, held = [], 0
        for texts in _in_turns(batches, COUNTED_CHARS):
            words, at, _ = tokenised(texts)
            counts.append((np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), np.bincount(at, minlength=len(words))))
            held += len(words)
            if held >= COUNTED_WORDS:
                counts = [_sum_by_key(*map(np.concatenate, zip(*counts)))]
                held = len(counts[0][0])
                if held >= COUNTED_WORDS:
                    yield flush(counts)
                    counts, held = [], 0
        if held:
            yield flush(counts)

    def merge(batches):
        import pyarrow as pa

        for piece, rows in _groups(batches):
            h, c = _sum_by_key(np.concatenate([np.frombuffer(r[1], dtype=np.uint64) for r in rows]), np.concatenate([np.frombuffer(r[2], dtype=np.int64) for r in rows]))
            write_bytes(f"{folder}/vocab-{piece}", pack({"h": h, "c": c}))
            yield _record([(piece, len(h), int(c.sum()), int((c == 1).sum()), int((c == 2).sum()))], ["piece", "v", "n", "n1", "n2"], [pa.int64()] * 5)

    rows = train.select("text").mapInArrow(count, "piece bigint, h binary, c binary").repartition(1 << bits, "piece").sortWithinPartitions("piece")
    made = materialise(rows.mapInArrow(merge, "piece bigint, v bigint, n bigint, n1 bigint, n2 bigint"), "lm-vocab").collect()  # a row per piece
    sizes = [0] * (1 << bits)
    for r in made:
        sizes[r["piece"]] = r["v"]
    return {"folder": folder, "bits": bits, "sizes": sizes, "words": sum(r["n"] for r in made), "n1": sum(r["n1"] for r in made), "n2": sum(r["n2"] for r in made)}


# --- the upper levels


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def _trigrams(ids: np.ndarray, starts: np.ndarray, end: int):
    """(u, v, w) for each pair of neighbours and what follows; the end is followed by itself."""
    u, v = ids[:-1], ids[1:]
    w = np.concatenate([ids[2:], [end]])
    inside = np.ones(len(u), dtype=bool)
    inside[starts[1:-1] - 1] = False  # an end and the next text's first word
    w = np.where(v == end, end, w)
    return u[inside], v[inside], w[inside]


def _upper(train: DataFrame, meta: dict) -> None:
    shards, folder = meta["shards"], meta["folder"]

    def chunk_rows(vocabulary, texts):
        import zstandard

        places, starts, (ids, *_) = vocabulary.encode(texts)
        if len(places) < 2:
            return []
        order = np.argsort(ids)  # ids in ascending order compress well
        local, rank = ids[order], np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        u, v, w = _trigrams(rank.take(places), starts, int(rank[0]))
        if len(local) < 1 << 21:
            key, n = np.unique((u << 42) | (v << 21) | w, return_counts=True)
            u, v, w = key >> 42, (key >> 21) & ((1 << 21) - 1), key & ((1 << 21) - 1)
        else:  # a single text of millions of different words
            (u, v, w), n = np.unique(np.stack([u, v, w]), axis=1, return_counts=True)
        u, v, w = local[u], local[v], local[w]
        pair = u * vocabulary.universe + v
        shard = shard_of(pair, shards)
        order = np.argsort(shard, kind="stable")
        shard, pair, w, n = shard[order], pair[order], w[order], n[order]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        squeeze = zstandard.ZstdCompressor(level=1).compress
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
            if b == a:
                continue
            p = pair[a:b] // vocabulary.universe
            planes = [np.diff(p, prepend=0), pair[a:b] % vocabulary.universe, w[a:b], n[a:b]]
            raw = b"".join(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in planes)
            rows.append((int(shard[a]), b - a, squeeze(raw)))
        return rows

    def count(batches):
        import pyarrow as pa

        vocabulary = Vocabulary(meta)
        for texts in _in_turns(batches, CHUNK_BYTES):
            if rows := chunk_rows(vocabulary, texts):
                yield _record(rows, ["shard", "n", "data"], [pa.int64(), pa.int64(), pa.binary()])

    def build(batches):
        import pyarrow as pa
        import zstandard

        vocabulary = Vocabulary(meta)
        expand, squeeze, universe = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress, vocabulary.universe
        for shard, parts in _streams(batches):
            pair, w, c = (np.zeros(0, dtype=np.int64) for _ in range(3))
            waiting: list = []
            for n, data in parts:
                planes = np.frombuffer(expand(data), dtype=np.uint8).reshape(4, 8, n)
                u, *rest = [np.ascontiguousarray(planes[k].T).view("<i8").ravel() for k in range(4)]
                waiting.append((np.cumsum(u) * universe + rest[0], *rest[1:]))
                if sum(len(x[0]) for x in waiting) >= max(WAITING, len(pair)):
                    pair, w, c = _added_up([(pair, w, c), *waiting])
                    waiting = []
            if waiting:
                pair, w, c123 = _added_up([(pair, w, c), *waiting])
            else:
                c123 = c
            pairs, first, t12 = np.unique(pair, return_index=True, return_counts=True)
            parent = np.repeat(np.arange(len(pairs)), t12)
            first = np.append(first, len(pair))
            c12 = np.add.reduceat(c123, first[:-1])
            heads, head_first, t1 = np.unique(pairs // universe, return_index=True, return_counts=True)
            head = np.repeat(np.arange(len(heads)), t1)
            a3, book_a3 = quantise(np.log10(c123 / (c12 + t12)[parent]))
            b3, book_b3 = quantise(np.log10(t12 / (c12 + t12)))
            arrays = ef_pack("heads", heads, universe) | ef_pack("level2", head * universe + pairs % universe, len(heads) * universe) | ef_pack("level3", parent * universe + w, len(pairs) * universe)
            arrays |= ef_pack("pointers2", np.append(head_first, len(pairs)), len(pairs) + 1) | ef_pack("pointers3", first, len(pair) + 1)
            write_bytes(f"{folder}/shard-{shard}", pack(arrays | {"a3": a3, "book_a3": book_a3, "b3": b3, "book_b3": book_b3}))
            write_bytes(f"{folder}/pairs-{shard}", [squeeze(c12.astype("<i8").tobytes())])
            known = heads < vocabulary.end
            piece = np.searchsorted(vocabulary.starts, heads[known], side="right") - 1
            yield _record(list(_pieces_of(heads[known], t1[known], piece)), ["piece", "h", "c"], [pa.int64(), pa.binary(), pa.binary()])

    def followers(batches):
        import pyarrow as pa

        starts = np.concatenate([[0], np.cumsum(meta["sizes"])])
        for piece, rows in _groups(batches):
            t = np.zeros(meta["sizes"][piece], dtype=np.int64)
            for _, h, c in rows:
                np.add.at(t, np.frombuffer(h, dtype=np.int64) - starts[piece], np.frombuffer(c, dtype=np.int64))
            write_bytes(f"{folder}/followers-{piece}", pack({"t": t.astype(np.uint32)}))
            yield _record([(piece,)], ["piece"], [pa.int64()])

    def smooth(batches):
        import pyarrow as pa
        import zstandard

        vocabulary = Vocabulary(meta, followers=True)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                if (x := _open(f"{folder}/shard-{shard}")) is None:
                    continue
                heads, pointers = EliasFano(x, "heads"), EliasFano(x, "pointers2")
                c12 = np.frombuffer(zstandard.ZstdDecompressor().decompress(open_map(f"{folder}/pairs-{shard}")), dtype="<i8")
                u = heads.get(np.arange(heads.n))
                known = u < vocabulary.end
                total = np.ones(len(u))
                c, t = vocabulary.counts_of(u[known])
                total[known] = c + t
                a2, book_a2 = quantise(np.log10(c12 / np.repeat(total, np.diff(pointers.get(np.arange(heads.n + 1))))))
                write_bytes(f"{folder}/second-{shard}", pack({"a2": a2, "book_a2": book_a2}))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64())})

    counted = train.select("text").mapInArrow(count, "shard bigint, n bigint, data binary").repartition(shards, "shard").sortWithinPartitions("shard")
    partial = counted.mapInArrow(build, "piece bigint, h binary, c binary").repartition(len(meta["sizes"]), "piece").sortWithinPartitions("piece")
    materialise(partial.mapInArrow(followers, "piece bigint"), "lm-followers")
    materialise(train.sparkSession.range(0, shards, 1, shards).mapInArrow(smooth, "shard bigint"), "lm-smooth")


def _added_up(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (pair, w, c) in order of pair and w, each once with the sum of its c."""
    pair, w, c = (np.concatenate(x) for x in zip(*parts))
    if not len(pair):
        return pair, w, c
    pairs, rank = np.unique(pair, return_inverse=True)
    width = int(w.max()) + 1
    key, c = _sum_by_key(rank * width + w, c)
    return pairs[key // width], key % width, c


def _open(uri: str) -> dict | None:
    """The arrays of a file, None where no pair fell into the shard."""
    try:
        return mapped(uri)
    except FileNotFoundError:
        return None


class Shard:
    """Probabilities are read from tables of the codes' values, which hold 10 ** the codes' logarithms."""

    def __init__(self, arrays: dict, second: dict, universe: int):
        x = self.arrays = arrays | second
        self.universe = universe
        self.heads, self.level2, self.level3, self.pointers2, self.pointers3 = (EliasFano(x, k) for k in ("heads", "level2", "level3", "pointers2", "pointers3"))
        self.a2, self.a3, self.b3 = (10.0 ** x[f"book_{k}"] for k in ("a2", "a3", "b3"))

    def look_up(self, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        """(c(uv)/(c(u)+T(u)), c(uvw)/(c(uv)+T(uv)), T(uv)/(c(uv)+T(uv))) by their codes; 0, 0, 1 where they aren't stored."""
        x = self.arrays
        a2, a3, b3 = np.zeros(len(u)), np.zeros(len(u)), np.ones(len(u))
        head = self.heads.find(u)
        at = np.flatnonzero(head >= 0)
        head = head[at]
        pair = self.level2.find(head * self.universe + v[at], *self.children(self.pointers2, head))
        at, pair = at[pair >= 0], pair[pair >= 0]
        a2[at], b3[at] = self.a2.take(x["a2"].take(pair)), self.b3.take(x["b3"].take(pair))
        third = self.level3.find(pair * self.universe + w[at], *self.children(self.pointers3, pair))
        a3[at[third >= 0]] = self.a3.take(x["a3"].take(third[third >= 0]))
        return a2, a3, b3

    @staticmethod
    def children(pointers: EliasFano, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of contexts begin and end; each context is looked up once."""
        new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=bool)
        which, one = np.cumsum(new) - 1, at[new]
        return pointers.get(one)[which], pointers.get(one + 1)[which]


class Model:
    def __init__(self, meta: dict):
        self.meta, self.vocabulary = meta, Vocabulary(meta, followers=True)
        self.n = meta["words"] + meta["docs"]
        self.v = self.vocabulary.end + (meta["docs"] > 0)
        n1, n2 = meta["n1"] + (meta["docs"] == 1), meta["n2"] + (meta["docs"] == 2)
        self.discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.shards: dict[int, Shard | None] = {}

    def shard(self, k: int) -> Shard | None:
        def open_shard() -> Shard | None:
            x = _open(f"{self.meta['folder']}/shard-{k}")
            return None if x is None else Shard(x, mapped(f"{self.meta['folder']}/second-{k}"), self.vocabulary.universe)

        return _kept_open(self.shards, k, open_shard)

    def score(self, texts):
        """(tokens, known tokens, base score, score) of each text of an Arrow array."""
        vocabulary, n, v = self.vocabulary, self.n, self.v
        places, starts, (word_ids, c, t) = vocabulary.encode(texts)
        if not n:
            return np.diff(starts), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), None
        sums = lambda x: np.add.reduceat(x, starts[:-1])
        # of each word: base, probability, and the share that its followers leave
        base = np.log10((c + ALPHA) / (n + ALPHA * (v + 1)))
        one = np.where(c > 0, (c - self.discount) / n, self.discount * v / n)
        left = np.where(c > 0, t / np.maximum(c + t, 1), 1.0)
        ids, known = word_ids.take(places), (c > 0).take(places)
        p = one.take(places)
        if len(ids) > 1:
            inside = np.ones(len(ids) - 1, dtype=bool)  # pairs (i, i + 1)
            inside[starts[1:-1] - 1] = False
            a2, a3, b3 = np.zeros(len(ids)), np.zeros(len(ids)), np.ones(len(ids))  # of the pair that ends here, and what follows
            ask = np.flatnonzero(inside & known[:-1] & known[1:]) + 1
            if len(ask):
                pair = ids[ask - 1] * vocabulary.universe + ids[ask]
                shard = shard_of(pair, self.meta["shards"])
                order = np.argsort(pair)  # in order within a shard, which keeps close what is read together
                order = order[np.argsort(shard[order].astype(np.uint16 if self.meta["shards"] <= 1 << 16 else np.int64), kind="stable")]
                ask, shard = ask[order], shard[order]
                u, w = ids[ask - 1], ids[ask]
                after = np.append(ids, vocabulary.end)[np.where(w == vocabulary.end, ask, ask + 1)]
                cuts = np.flatnonzero(np.diff(shard)) + 1
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                    if found := self.shard(int(shard[x])):
                        a2[ask[x:y]], a3[ask[x:y]], b3[ask[x:y]] = found.look_up(u[x:y], w[x:y], after[x:y])
            q = p.copy()
            q[1:] = np.where(inside, a2[1:] + left.take(places[:-1]) * p[1:], p[1:])
            # a pair's own part and rest, for the token after it in the same text
            p = q.copy()
            p[2:] = np.where(inside[1:] & inside[:-1], a3[1:-1] + b3[1:-1] * q[2:], q[2:])
        return np.diff(starts), sums(known.astype(np.int64)), sums(base.take(places)), sums(np.log10(p))


def train(docs: DataFrame) -> dict:
    """Counts n-grams of docs.text, writes the trie and returns where and how large it is."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "lm")
    size = docs.agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).first()
    tokens = (size["bytes"] or 0) // 6
    parts = max(4, -(-tokens // SHARD_TOKENS))
    meta = _vocabulary(docs, folder, parts) | {"docs": size["docs"], "shards": parts}
    _upper(docs, meta)
    return meta


_models: dict[str, Model] = {}


def _model(meta: dict) -> Model:
    if meta["folder"] not in _models:
        _models.clear()
        _models[meta["folder"]] = Model(meta)
    return _models[meta["folder"]]


def annotate(df: DataFrame, meta: dict, without: tuple = ()) -> DataFrame:
    """df, less the columns of `without`, with n_tokens, n_known, base_score and score."""
    from pyspark.sql import types as T

    def start():
        import pyarrow as pa

        model = _model(meta)

        def each(texts):
            n, known, base, score = model.score(texts)
            return [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score) if score is not None else pa.nulls(len(n), pa.float64())]

        return each

    return arrow_columns(df, "text", [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())], start, SCORE_ROWS, without)


def score(docs: DataFrame, held_by: int = 10, held: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text")
    meta = train(docs.filter(remainder(F.col("doc_id"), held_by) != held))
    out = annotate(docs, meta, ("text",))
    return out.select("doc_id", is_held_out(F.col("doc_id"), held_by, held).alias("held_out"), "n_tokens", "n_known", F.lit(meta["words"] + meta["docs"]).cast("long").alias("train_tokens"), "base_score", "score")

