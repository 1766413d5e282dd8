"""Token ids on disk: shared zstandard dictionary, one frame per document.

Layout below a folder: ``dictionary`` (one row: hash, bytes) and ``shards``
(Parquet, one row per shard).  A shard's ``frames`` are the zstandard frames
of its documents end to end, each compressed alone with the shared dictionary
over the ids as little-endian unsigned 32- or 16-bit numbers; its ``entries``
are the offset index (doc_id, frame offset, frame length, ids).  Shards carry
the dictionary's hash, their part (parts ascend with doc_id), the number of
ids before them in their part and their first and last doc_id, so that a few documents can be read without the rest.
Spark's writer commits the files, so a retried task leaves no half shard.

The dictionary is trained on the ids of at most SAMPLE_DOCS documents, those
of least hash, and at most SAMPLE_BYTES of ids.

Defined results: null text counts as the empty text; a null doc_id sorts
first; rows with equal ids and texts are all kept; an empty table gives an
empty store.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import string
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from durata.llm.hashing import SPACED

SAMPLE_DOCS = 1_000
SAMPLE_BYTES = 8 << 20
#: Below this many bytes of sampled ids no dictionary is trained.
LEAST_SAMPLE = 64 << 10
DICT_BYTES = 64 << 10
LEVEL = 3
SHARD_BYTES = 4 << 20
#: Distinct words a worker remembers; it starts afresh beyond.
MEMORY = 1_500_000
_PLAIN = re.compile("[a-z]+")
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,")] = True
_LETTER[list(string.ascii_letters.encode())] = True
_ENTRY = np.dtype([("null", "?"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u8")])
SHARD_SCHEMA = ("part int, base long, first_id long, last_id long, n_docs long, n_tokens long, "
                "dict_hash string, width int, entries binary, frames binary")


class WordEncoder:
    """Ids of whole texts from a ``tokenizers`` file whose pre-tokenizer drops
    white space: no token spans two words, so each distinct word (between
    ASCII white space) goes through the library once per worker.  ASCII
    letters are lowered first if the tokenizer's normalizer lowers anyway, and
    stops and commas behind an ASCII letter are words of their own if the
    pre-tokenizer parts them anyway."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.lowers = self._ids(string.ascii_uppercase) == self._ids(string.ascii_lowercase)
        if self._ids("a b") != self._ids("a") + self._ids("b"):
            raise ValueError("this tokenizer keeps white space; words cannot be encoded one by one")
        self.parts = all(self._ids(f"{x}{p}") == self._ids(f"{x} {p}") for x in string.ascii_letters
                         for p in (".", ",", "..", ",.", ",,", ".,", "..."))
        # for words of small ASCII letters, normalizer and splitting pattern change nothing
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer, self.lean.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        probe = " ".join(a + b * k for a in string.ascii_lowercase for b in string.ascii_lowercase for k in (0, 1, 4))
        if self.lean.encode(probe, add_special_tokens=False).ids != self._ids(probe):
            self.lean = self.tok
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, "<u4")
        self.lengths = np.zeros(0, np.int64)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and how many each word has.

        A word of letters alone is one piece for the tokenizer, and a piece's
        last token is marked as such; so words of letters go to the library
        many at a time and are told apart by the marks.  Should the marks not
        tally, and for all other words, each is encoded by itself.
        """
        groups = [words[lo:lo + 50] for lo in range(0, len(words), 50)]
        lean = [all(map(_PLAIN.fullmatch, g)) for g in groups]
        coded = {}
        for tok, kind in ((self.lean, True), (self.tok, False)):
            mine = [i for i, x in enumerate(lean) if x == kind]
            coded.update(zip(mine, tok.encode_batch_fast([" ".join(groups[i]) for i in mine], add_special_tokens=False),
                             strict=True))
        ids, lengths = [], []
        for g, e in ((g, coded[i]) for i, g in enumerate(groups)):
            x = np.array(e.ids, "<u4")
            last = np.flatnonzero(self.ends[x])
            if len(last) == len(g) and last[-1] == len(x) - 1 and all(map(str.isalpha, g)):
                n = np.diff(last, prepend=-1)
            else:
                each = [e.ids for e in self.tok.encode_batch_fast(g, add_special_tokens=False)]
                n = np.fromiter(map(len, each), np.int64, len(each))
                x = np.fromiter(itertools.chain.from_iterable(each), "<u4", int(n.sum()))
            ids.append(x)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, new: list[bytes]) -> None:
        text = [w.decode() for w in new]
        order = sorted(range(len(new)), key=lambda i: (not text[i].isalpha(), not text[i].isascii(), not text[i].islower()))
        ids, lengths = self._encode_words([text[i] for i in order])
        self.place.update(zip([new[i] for i in order], range(len(self.place), len(self.place) + len(new)), strict=True))
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])

    def _words(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in a buffer that ends in white space;
        stops and commas at a word's end, behind an ASCII letter, are a word
        of their own."""
        edge = np.diff(SPACED[a].view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not self.parts:
            return start, end
        w = np.flatnonzero(_STOP[a[end - 1]])
        cut = end[w] - 1
        more = np.arange(len(w))
        while len(more):
            more = more[(cut[more] > start[w[more]]) & _STOP[a[cut[more] - 1]]]
            cut[more] -= 1
        ok = (cut > start[w]) & _LETTER[a[cut - 1]]
        w, cut = w[ok], cut[ok]
        return np.insert(start, w + 1, cut), np.insert(end, w, cut)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers."""
        import pyarrow as pa

        buf = b"\n".join(texts) + b"\n"
        a = np.frombuffer(buf.lower() if self.lowers else buf, np.uint8)
        start, end = self._words(a)
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(a[SPACED[a]])])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.place) > MEMORY:
            self._forget()
        new = [w for w in distinct if w not in self.place]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        # ids of this block's distinct words, then of all its words, as Arrow lists
        table = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(self.lengths)]), pa.array(self.ids))
        every = table.take(pa.array(place)).take(coded.indices)
        ids, ends = every.flatten().to_numpy(), every.offsets.to_numpy()
        base = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = ends[np.searchsorted(start, base)]
        return [ids[cuts[i]:cuts[i + 1]].tobytes() for i in range(len(texts))]


_open: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _open:
        _open[path] = WordEncoder(path)
    return _open[path]


def _with_end(ids: bytes, end_id: int | None) -> bytes:
    return ids if end_id is None else ids + struct.pack("<I", end_id)


def id_width(tokenizer: str, end_id: int | None) -> int:
    """Bytes that the greatest id of a tokenizer file, or ``end_id``, needs: 2 or 4."""
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), end_id or 0]
    if not 0 <= min(ids) <= max(ids) < 2 ** 32:
        raise ValueError("ids must be unsigned 32-bit numbers")
    return 2 if max(ids) < 2 ** 16 else 4


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")


def _chunks(batch, limit: int = 4 << 20):
    """(ids, texts) of a batch in pieces of about ``limit`` bytes."""
    import pyarrow as pa

    keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
    at = 0
    while at < len(keys):
        end, size = at, 0
        while end < len(keys) and (end == at or size < limit):
            size += len(texts[end] or b"")
            end += 1
        yield keys[at:end], [t or b"" for t in texts[at:end]]
        at = end


def train_dictionary(rows: DataFrame, tokenizer: str, end_id: int | None, width: int) -> bytes:
    """The shared dictionary: raw bytes, empty if there is too little text."""
    import zstandard

    # the sample is chosen by doc_id alone; SAMPLE_DOCS ids at most are broadcast
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text")

    def work(batches):
        import pyarrow as pa

        enc = _encoder(tokenizer)
        for b in batches:
            for _, texts in _chunks(b):
                out = [_narrow(_with_end(x, end_id), width) for x in enc(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    samples, size = [], 0
    for r in sample.mapInArrow(work, "ids binary").limit(SAMPLE_DOCS).collect():
        if size + len(r.ids) > SAMPLE_BYTES:
            break
        samples.append(bytes(r.ids))
        size += len(r.ids)
    if size < LEAST_SAMPLE or len(samples) < 16:
        return b""
    return zstandard.train_dictionary(min(DICT_BYTES, size // 8), samples, level=LEVEL).as_bytes()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Encode every whole text of ``docs`` and write the store at ``path``;
    ids take two bytes if the tokenizer's and the end id all fit, else four."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    width = id_width(tokenizer, end_id)
    trained = train_dictionary(rows, tokenizer, end_id, width)
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(digest, bytearray(trained))], "dict_hash string, bytes binary").coalesce(1).write.parquet(
        f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(trained)

    def work(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = _encoder(tokenizer)
        d = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
        base, size, entries, frames = 0, 0, [], []

        def shard():
            index = np.array(entries, _ENTRY)
            real = index["doc_id"][~index["null"]]
            first, last = (int(real[0]), int(real[-1])) if len(real) else (None, None)
            row = [part, base, first, last, len(index), int(index["n_tokens"].sum()), digest, width,
                   index.tobytes(), b"".join(frames)]
            types = [pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32(), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for b in batches:
            for keys, texts in _chunks(b):
                for key, ids in zip(keys, enc(texts), strict=True):
                    ids = _with_end(ids, end_id)
                    frame = z.compress(_narrow(ids, width))
                    entries.append((key is None, key or 0, size, len(frame), len(ids) // 4))
                    frames.append(frame)
                    size += len(frame)
                    if size >= SHARD_BYTES:
                        yield shard()
                        base, size, entries, frames = base + sum(e[4] for e in entries), 0, [], []
        if entries:
            yield shard()

    # documents in ascending order over the partitions; the second key spreads rows that share a doc_id
    tie = F.xxhash64("text")
    (rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
     .mapInArrow(work, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/shards"))


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    r = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(r.bytes).hexdigest() != r.dict_hash:
        raise ValueError(f"the dictionary of {path} is damaged")
    return r.dict_hash, bytes(r.bytes)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids of all parts before each one; one row per part,
    so no more than the writing job had partitions."""
    parts = shards(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``with_ids``) the ids of each
    document, from the files.  With ``doc_ids``, shards whose range holds none
    are skipped by their statistics and only those documents' frames are
    decompressed."""
    digest, trained = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(trained)
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    rows = shards(spark, path)
    if wanted is not None:
        if not wanted:
            rows = rows.filter(F.lit(False))
        else:
            rows = rows.filter((F.col("first_id") <= wanted[-1]) & (F.col("last_id") >= wanted[0]))
    rows = rows.join(F.broadcast(part_starts(spark, path)), "part").select(
        (F.col("base") + F.col("before")).alias("base"), "dict_hash", "width", "entries", "frames")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def work(batches):
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        z = zstandard.ZstdDecompressor(dict_data=d)
        for b in batches:
            for base, hashed, width, entries, frames in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if hashed != digest:
                    raise ValueError("a shard was written with another dictionary")
                index = np.frombuffer(entries, _ENTRY)
                start = base + np.cumsum(index["n_tokens"].astype(np.int64)) - index["n_tokens"].astype(np.int64)
                take = np.arange(len(index))
                if wanted is not None:
                    take = np.flatnonzero(np.isin(index["doc_id"], wanted) & ~index["null"])
                view, crc, lists = memoryview(frames), [], []
                for e in index[take]:
                    ids = _wide(z.decompress(view[int(e["offset"]):int(e["offset"]) + int(e["length"])]), width)
                    if len(ids) != e["n_tokens"]:
                        raise ValueError("a frame does not hold the ids its index names")
                    crc.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        lists.append(ids.tolist())
                cols = [pa.array(index["doc_id"][take], mask=index["null"][take]), pa.array(start[take]),
                        pa.array(index["n_tokens"][take].astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(work, schema)
