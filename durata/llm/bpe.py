"""Byte-level BPE encoding and decoding over padded numpy matrices.

Pieces (matches of the split pattern) are bucketed by length into padded
matrices.  In each round every row merges its leftmost pair of least rank:
ranks come from a hash table over pairs of ids, merged rows are compacted to
the left, and rows without a mergeable pair leave the matrix.

Rows of over LONG bytes merge all places of the least rank in one round
where that gives the same result (see ``_merge_runs``), so that a text
without any space stays affordable.

Defined results: null text encodes like the empty text, to no ids; repeated
rows are encoded each on its own; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import regex

LONG = 96
#: Pieces whose ids a worker remembers; it starts afresh beyond.
MEMORY = 1_000_000
_U = np.uint64
NO_RANK = np.int32(2 ** 31 - 1)


class PairTable:
    """(left id, right id) -> rank of the merged token, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(2 * len(rank)).bit_length())
        self.mask = _U(size - 1)
        self.keys = np.full(size, 2 ** 64 - 1, np.uint64)
        self.ranks = np.full(size, NO_RANK, np.int32)
        key = self._key(left, right)
        at = self._slot(key)
        todo = np.arange(len(key))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == _U(2 ** 64 - 1)
            _, won = np.unique(at[todo][free], return_index=True)
            placed = todo[free][won]
            self.keys[at[placed]] = key[placed]
            self.ranks[at[placed]] = rank[placed]
            left_over = np.ones(len(todo), bool)
            left_over[np.flatnonzero(free)[won]] = False
            todo = todo[left_over]
            at[todo] = (at[todo] + _U(1)) & self.mask

    @staticmethod
    def _key(left, right) -> np.ndarray:
        return (left.astype(np.uint64) << _U(32)) | right.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _U(0x9E3779B97F4A7C15)) >> _U(40)) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        ok = (left >= 0) & (right >= 0)
        key = self._key(left[ok], right[ok])
        at = self._slot(key)
        found = np.full(len(key), NO_RANK, np.int32)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            here = self.keys[at[todo]]
            hit = here == key[todo]
            found[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (here != _U(2 ** 64 - 1))]
            if not len(todo):
                break
            at[todo] = (at[todo] + _U(1)) & self.mask
        out = np.full(shape, NO_RANK, np.int32)
        out[ok] = found
        return out


class Vocabulary:
    """Token bytes by rank, and the pairs of tokens that make a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        trio = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                if t[:i] in ranks and t[i:] in ranks]
        a = np.array(trio, np.int64).reshape(-1, 3)
        self.pairs = PairTable(a[:, 0], a[:, 1], a[:, 2].astype(np.int32))

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece.  A piece that is a token is that token, even one
        that no sequence of merges reaches."""
        out: list = [None if (r := self.ranks.get(p)) is None else np.array([r], np.int32) for p in pieces]
        todo = np.array([i for i, x in enumerate(out) if x is None], np.int64)
        if not len(todo):
            return out
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # bucket 2, 3-4, 5-8, 9-16, ... bytes; a bucket's matrix holds about 4 MB of ids at most
        bucket = np.ceil(np.log2(np.maximum(sizes[todo], 2))).astype(int)
        for b in np.unique(bucket):
            rows = todo[bucket == b]
            step = max(1, (1 << 20) >> int(b))
            for lo in range(0, len(rows), step):
                part = rows[lo:lo + step]
                width = int(sizes[part].max())
                joined = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
                inside = np.arange(width) < sizes[part][:, None]
                m = np.full((len(part), width), -1, np.int32)
                m[inside] = self.of_byte[joined]
                self._merge(m, part, out)
        return out

    def _merge(self, m: np.ndarray, rows: np.ndarray, out: list) -> None:
        width = m.shape[1]
        ranks = self.pairs(m[:, :-1], m[:, 1:])
        while True:
            least = ranks.min(axis=1) if ranks.shape[1] else np.full(len(m), NO_RANK)
            done = least == NO_RANK
            if done.any():
                for i, row in zip(rows[done], m[done], strict=True):
                    out[i] = row[row >= 0]
                live = ~done
                m, ranks, rows, least = m[live], ranks[live], rows[live], least[live]
            if not len(m):
                return
            if width > LONG:
                m = np.stack(self._pad([self._merge_runs(r[r >= 0], k, int(x))
                                        for r, k, x in zip(m, ranks, least, strict=True)]))
                ranks = self.pairs(m[:, :-1], m[:, 1:])
                width = m.shape[1]
                continue
            r = np.arange(len(m))
            at = ranks.argmin(axis=1)
            m[r, at] = least
            # compaction: what stands right of the merged pair moves one place left
            n = m.shape[1]
            cols = np.arange(n - 1)
            src = cols + (cols > at[:, None])
            merged = np.take_along_axis(m, src, axis=1)
            if n > 2:
                old = ranks[:, :-1]
                ranks = np.where(cols[:-1] < at[:, None], old, np.take_along_axis(ranks, src[:, :-1], axis=1))
                for side in (-1, 0):
                    k = at + side
                    ok = (k >= 0) & (k < n - 2)
                    i = r[ok]
                    ranks[i, k[ok]] = self.pairs(merged[i, k[ok]], merged[i, k[ok] + 1])
            else:
                ranks = np.zeros((len(m), 0), np.int32)
            m = merged

    @staticmethod
    def _pad(rows: list[np.ndarray]) -> list[np.ndarray]:
        width = max(map(len, rows))
        return [np.pad(x, (0, width - len(x)), constant_values=-1) for x in rows]

    def _merge_runs(self, ids: np.ndarray, ranks: np.ndarray, least: int) -> np.ndarray:
        """All places of rank ``least`` merged, left to right without overlap.

        That equals merging the leftmost one again and again as long as no
        pair made on the way ranks lower; if one does, only the leftmost is
        merged.
        """
        hits = np.flatnonzero(ranks[:len(ids) - 1] == least)
        if len(hits) > 1:
            run = np.concatenate([[0], np.flatnonzero(np.diff(hits) != 1) + 1])
            first = np.repeat(hits[run], np.diff(np.append(run, len(hits))))
            hits = hits[(hits - first) % 2 == 0]
        for taken in (hits, hits[:1]):
            new = ids.copy()
            new[taken] = least
            keep = np.ones(len(ids), bool)
            keep[taken + 1] = False
            # pairs that existed on the way: merged token with the old token to its right, and the final ones
            right = taken[taken + 2 < len(ids)]
            made = self.pairs(new[right], ids[right + 2])
            new = new[keep]
            if len(taken) == 1:
                return new
            spots = taken - np.arange(len(taken))
            before, after = spots[spots > 0], spots[spots + 1 < len(new)]
            low = [made, self.pairs(new[before - 1], new[before]), self.pairs(new[after], new[after + 1])]
            if all((x > least).all() for x in low):
                return new
        return new

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.starts, self.lengths, ids, self.bytes)[0].tobytes()


def _gather(starts: np.ndarray, lengths: np.ndarray, which: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``table`` named by ``which``, end to end, and their ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(starts[which] - ends + n, n) + np.arange(total)], ends


class Encoder:
    """Encodes blocks of texts; each distinct piece of a task goes through the
    matrices once, and the ids of those that come up again stay in the worker's
    memory."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        decimals = [b"%d," % i for i in range(vocabulary.size)]
        self.dec_lengths = np.fromiter(map(len, decimals), np.int64, vocabulary.size)
        self.dec_starts = np.cumsum(self.dec_lengths) - self.dec_lengths
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)

    def rest(self) -> None:
        """Keeps the pieces that came up in two blocks or more since the last
        rest; the others only take room from the worker's next steps."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > MEMORY // 2:
            self._forget()
            return
        pieces = list(self.place)
        self.ids = _gather(np.cumsum(self.lengths) - self.lengths, self.lengths, keep, self.ids)[0]
        self.lengths, self.used = self.lengths[keep], np.ones(len(keep), np.int32)
        self.place = {pieces[k]: i for i, k in enumerate(keep.tolist())}

    def learn(self, new: list[str]) -> None:
        coded = self.v.encode_pieces([p.encode() for p in new])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, coded), np.int64, len(coded))])
        self.ids = np.concatenate([self.ids, *coded])
        self.used = np.concatenate([self.used, np.zeros(len(coded), np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts end to end, and the end of each text's."""
        pieces: list[str] = []
        cuts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            pieces += self.v.pattern.findall(t)
            cuts[i] = len(pieces)
        if len(self.place) > MEMORY:
            self.rest()
        new = list(set(pieces).difference(self.place))
        if new:
            self.learn(new)
        which = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        self.used[np.unique(which)] += 1
        ids, ends = _gather(np.cumsum(self.lengths) - self.lengths, self.lengths, which, self.ids)
        return ids, np.concatenate([[0], ends])[cuts]

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, str]]:
        """Per text: sha256 of its ids as decimals joined by commas, and of
        the bytes that its ids decode to."""
        text, text_ends = _gather(self.dec_starts, self.dec_lengths, ids, self.decimals)
        back, back_ends = _gather(self.v.starts, self.v.lengths, ids, self.v.bytes)
        text_ends, back_ends = np.concatenate([[0], text_ends])[ends], np.concatenate([[0], back_ends])[ends]
        a = b = 0
        for c, d in zip(text_ends.tolist(), back_ends.tolist(), strict=True):
            yield hashlib.sha256(text[a:max(a, c - 1)]).hexdigest(), hashlib.sha256(back[b:d]).hexdigest()
            a, b = c, d


_open: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a rank file; made once."""
    if (path, pattern) not in _open:
        _open[path, pattern] = Encoder(Vocabulary.from_file(path, pattern))
    return _open[path, pattern]


BATCH_BYTES = 1 << 20


def encode(docs, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True):
    """Per document: doc_id, n_tokens, ids (array of int, if ``with_ids``),
    ids_sha256 and decoded_sha256 (digest of the bytes the ids decode to).

    ``path`` names a rank file that every worker can read; the vocabulary
    stays in the worker between tasks.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import functions as F

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        schema, names = schema + ", ids array<int>", [*names, "ids"]

    def work(batches):
        enc = encoder(path, pattern)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            at = 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size < BATCH_BYTES):
                    size += sizes[end]
                    end += 1
                # only this block's texts are Python objects
                ids, ends = enc.encode([t or "" for t in texts.slice(at, end - at).to_pylist()])
                h1, h2 = zip(*enc.digests(ids, ends), strict=True)
                cols = [keys.slice(at, end - at), pa.array(np.diff(ends, prepend=0)), pa.array(h1), pa.array(h2)]
                if with_ids:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at = end
        enc.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)
