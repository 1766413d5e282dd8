"""Toxicity by compression distance.

Two zstandard dictionaries come from labelled texts.  The ordinary one is
trained by the library on ordinary text.  The toxic one holds the segments
that toxic text uses far more often than ordinary text (counted over byte
grams that lie within a word), those of most texts last, after the ordinary
dictionary, so that they are near; the ordinary one is followed by as many
bytes that match nothing.  So both reach ordinary material at the same
distances, and the compressed lengths of a window differ only by what toxic
text explains.  To
keep that difference, the ordinary dictionary is trained without the pieces
of ordinary text that hold a toxic segment.

The first HEAD bytes of each word are put in capitals and the rest in small
letters, so that the compressor tells a stem that begins a word from the same
letters inside another.

Every window of a text is compressed with both; mean gain, greatest gain and
the shares of windows that gain at three thresholds go through slopes
calibrated (logistic regression) on labelled texts that the dictionaries have
not seen, weighted by the numbers of labels, so that the score does not move
with the make-up of the sample.

Training takes at most TRAIN_DOCS texts of each label, those of least hash,
and as many of them as fit into TRAIN_BYTES (one that does not fit is left
out), CALIBRATION_DOCS of them for the calibration; the lengths are summed
before any text reaches the driver.  Scoring covers all windows of all texts.

Defined results: null and empty texts have one empty window and get a score;
very long texts are scored whole, window by window; repeated rows get the same
score; an empty table gives an empty table; without labels of both kinds the
score is their mean (0.5 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.hashing import mix, utf8
from durata.llm.quality_mil import sample

WINDOW, STEP, LEVEL = 64, 48, 9
HEAD = 6
GRAMS = (5, 7)
GRAM = 5
PIECE = 256
ORDINARY_BYTES = 100_000
#: The trainer wants this many times a dictionary's size in samples.
TRAINER_NEEDS = 40
TOXIC_BYTES = 8_000
TRAIN_DOCS = 10_000
TRAIN_BYTES = 16 << 20
#: Of these, so many of each label take part in the calibration.
CALIBRATION_DOCS = 3_000
#: A gram is toxic if LEAST toxic texts hold it, it is FACTOR times as frequent, per byte, as in ordinary text, and
#: the log likelihood ratio of its places against one frequency for both kinds is EVIDENCE.
LEAST, FACTOR, EVIDENCE = 4, 10, 14
FOLDS = 3
BATCH = 500_000
NOTABLE = 3
#: The compressor does not index a dictionary's last bytes; these match nothing.
END = bytes(range(0xF8, 0x100)) * 2
_TABLE = bytes(0x20 if b in b"\t\n\r\x0b\x0c" else b for b in range(256)).lower()


def plain(text: bytes) -> bytes:
    """White space as spaces; ASCII letters as capitals among the first HEAD
    bytes of a word, else small."""
    a = np.frombuffer(text.translate(_TABLE), np.uint8).copy()
    small = (a >= 0x61) & (a <= 0x7A)
    letter = small | (a >= 0x80)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    at = np.arange(len(a))
    since = at - np.maximum.accumulate(np.where(first, at, 0)) if len(a) else at
    a[small & (since < HEAD)] -= 0x20
    return a.tobytes()


def windows(text: bytes) -> list[bytes]:
    return [text[i:i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP)]


def _grams(text: bytes, size: int = GRAM) -> np.ndarray:
    """The number that the ``size`` (8 at most) bytes at each place of a text form."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(a) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for k in range(size):
        g = (g << np.uint64(8)) | a[k:n + k]
    return g


def _within(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def _word_grams(text: bytes, size: int) -> np.ndarray:
    """Grams within a word; a space may begin them."""
    g = _grams(text, size)
    keep = np.ones(len(g), bool)
    for k in range(size - 1):
        keep &= (g >> np.uint64(8 * k)) & np.uint64(0xFF) != 0x20
    return g[keep]


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return (keys, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(keys)) for i in (1, 2)))


def _counts(texts: list[bytes], size: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams within words, their places and the texts that hold them; a text
    counts at most one place for every PIECE bytes.  ``among`` (sorted) limits
    the grams.  Texts are added up BATCH grams at a time, so that memory
    follows the distinct grams."""
    none = np.zeros(0)
    total, parts, waiting = (none.astype(np.uint64), none, none), [], 0
    for t in texts:
        x = _word_grams(t, size)
        u, c = np.unique(x if among is None else x[_within(among, x)], return_counts=True)
        parts.append((u, np.minimum(c, len(t) // PIECE + 1), np.ones(len(u))))
        waiting += len(u)
        if waiting > BATCH:
            total, parts, waiting = _merged([total, *parts]), [], 0
    return _merged([total, *parts])


def distinct(texts: list[bytes]) -> list[bytes]:
    """``texts`` without those that nearly copy an earlier one (4 of 8
    min-hashes over 21-byte windows equal), so that a group of copies counts
    once."""
    salts = np.random.default_rng(9).integers(1, 2 ** 63, 8, dtype=np.uint64) | np.uint64(1)
    held, out = np.zeros((len(texts), 8), np.uint64), []
    for t in dict.fromkeys(texts):
        g = _grams(t)
        g = mix(g[:-16]) + g[16:] if len(g) > 16 else g
        if not len(g):
            continue
        print_ = np.array([mix(g * s).min() for s in salts])
        if not len(out) or ((held[:len(out)] == print_).sum(axis=1) < 4).all():
            held[len(out)] = print_
            out.append(t)
    return out or texts[:1]


def toxic_grams(toxic: list[bytes], ordinary: list[bytes], size: int) -> np.ndarray:
    """Grams within a word (a space may begin them) that LEAST toxic texts
    hold, that are FACTOR times as frequent there as in ordinary texts, and
    that chance does not explain (EVIDENCE)."""
    g, n, held = _counts(toxic, size)
    keep = held >= LEAST
    g, n = g[keep], n[keep]
    h, m, _ = _counts(ordinary, size, g)
    other = np.zeros(len(g))
    other[np.searchsorted(g, h)] = m
    t, o = sum(map(len, toxic)), max(1, sum(map(len, ordinary)))
    both = (n + other) / (t + o)
    evidence = n * np.log(n / (t * both)) + other * np.log(np.maximum(other, 1) / (o * both))
    return g[(n / t >= FACTOR * other / o) & (evidence >= EVIDENCE)]


def toxic_segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Runs of bytes that toxic grams cover, as far as LEAST texts hold the
    run, by the number of these texts, most last; those that TOXIC_BYTES have
    no room for are the least frequent."""
    covered = [np.zeros(len(t), bool) for t in toxic]
    for size in GRAMS:
        good = toxic_grams(toxic, ordinary, size)
        for t, c in zip(toxic, covered, strict=True):
            hit = np.flatnonzero(_within(good, _grams(t, size)))
            for k in range(size):
                c[hit + k] = True
    held: dict[bytes, int] = {}
    for t, c in zip(toxic, covered, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
        for run in {t[lo:hi] for lo, hi in zip(edges[::2], edges[1::2], strict=True)}:
            held[run] = held.get(run, 0) + 1
    out, size = [], 0
    for run, n in sorted(held.items(), key=lambda x: (-x[1], x[0])):
        if n >= LEAST and size + len(run) <= TOXIC_BYTES:
            out.append(run)
            size += len(run)
    return out[::-1]


def without_segments(texts: list[bytes], segments: list[bytes]) -> list[bytes]:
    """Pieces of ``texts`` in which no long gram of the segments begins."""
    size = GRAMS[-1]
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_grams(s, size) for s in segments]]))
    out = []
    for t in texts:
        held = set((np.flatnonzero(_within(grams, _grams(t, size))) // PIECE).tolist())
        out += [t[i:i + PIECE] for i in range(0, len(t), PIECE) if i // PIECE not in held]
    return out


def _trained(samples: list[bytes]) -> bytes:
    """Content of a dictionary trained by the library, as large as the samples
    allow; what it leaves free of ORDINARY_BYTES is filled with sample text."""
    import zstandard

    size = min(ORDINARY_BYTES, sum(map(len, samples)) // TRAINER_NEEDS)
    trained = b""
    if size >= 1024:
        trained = zstandard.train_dictionary(size, samples).as_bytes()
    return (b"".join(samples)[-ORDINARY_BYTES:] + trained)[-ORDINARY_BYTES:]


class Distance:
    """Gains of a text's windows; the dictionaries are plain bytes, so that
    the object can be sent to workers."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        segments = toxic_segments(toxic, ordinary)
        self.segments = b"".join(segments)
        self.ordinary = _trained(without_segments(ordinary, segments))
        # bytes 0x80-0xFF in a fixed random order hold no UTF-8 sequence of any length
        noise = np.random.default_rng(5).integers(0xF8, 0x100, len(self.segments)).astype(np.uint8).tobytes()
        self.noise = noise
        self._open()

    def _open(self):
        import zstandard

        def with_dictionary(data):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if data else None
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False).compress

        self.by_toxic, self.by_ordinary = (with_dictionary(self.ordinary + self.segments + END),
                                           with_dictionary(self.ordinary + self.noise + END))

    def __getstate__(self):
        return {"segments": self.segments, "ordinary": self.ordinary, "noise": self.noise}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def gains(self, text: bytes) -> np.ndarray:
        a, b = self.by_ordinary, self.by_toxic
        return np.array([len(a(w)) - len(b(w)) for w in windows(plain(text))], np.float64)

    def features(self, text: bytes) -> tuple[list[float], int]:
        g = self.gains(text)
        return summary(g), len(g)


def summary(g: np.ndarray) -> list[float]:
    """Mean gain, mean beyond 1, shares of windows at three thresholds, and
    the greatest gain, each as its square root."""
    x = [min(1.0, float(g.mean())), min(1.0, float(np.maximum(g - 1, 0).mean())), float((g >= 1).mean()),
         float((g >= 2).mean()), float((g >= NOTABLE).mean()), min(6.0, float(g.max()))]
    return np.sqrt(np.maximum(x, 0)).tolist()


class Model:
    """Scores by gains; ``weight`` is what a calibration row stands for, 1 on
    the average."""

    def __init__(self, distance: Distance, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.distance = distance
        self.mean = np.average(x, axis=0, weights=weight)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=weight)) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        beta = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], 0.01)
        ridge[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            w = weight * np.maximum(p * (1 - p), 1e-6)
            move = np.linalg.solve(z.T @ (w[:, None] * z) + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
            beta = beta + np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-6:
                break
        self.beta = beta

    def score(self, text: bytes) -> tuple[float, int]:
        row, n = self.distance.features(text)
        z = self.beta[0] + ((np.array(row) - self.mean) / self.scale) @ self.beta[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), n


def _without(texts: list[bytes], k: int) -> list[bytes]:
    return [t for i, t in enumerate(texts) if i % FOLDS != k] if len(texts) >= FOLDS else texts


def _texts(rows: DataFrame) -> list[bytes]:
    """Texts in the order of their hashes, as many as fit into TRAIN_BYTES."""
    rows = rows.select("h", F.coalesce("text", F.lit("")).alias("text"))
    fit, size = set(), 0
    for h, n in sorted(tuple(r) for r in rows.groupBy("h").agg(F.sum(F.octet_length("text"))).collect()):
        if size + n <= TRAIN_BYTES:
            fit.add(h)
            size += n
    chosen = rows.sparkSession.createDataFrame([(h,) for h in sorted(fit)], "h long")
    return [plain(r.text.encode()) for r in sorted(rows.join(F.broadcast(chosen), "h").select("h", "text").collect())]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
          limit: int = TRAIN_DOCS):
    """A Model from at most ``limit`` texts of each label; a number if there
    is but one label.  The calibration sees each of FOLDS parts of the texts
    through dictionaries of the others; the model's own come from all."""
    counts = {r[0]: r[1] for r in labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int")).count().collect()}
    ordinary, toxic = (_texts(sample(docs, labels.filter(F.col(label_col) == label), limit, id_col, text_col, label_col))
                       for label in (0, 1))
    if not ordinary or not toxic:
        return 1.0 if toxic else 0.0 if ordinary else 0.5
    rows, marks = [], []
    toxic, ordinary = distinct(toxic), distinct(ordinary)
    for k in range(FOLDS):
        # calibrate on texts that the dictionaries have not seen
        d = Distance(_without(toxic, k), _without(ordinary, k))
        for texts, mark in ((ordinary, 0), (toxic, 1)):
            part = (texts[k::FOLDS] if len(texts) >= FOLDS else texts)[:CALIBRATION_DOCS // FOLDS]
            rows += [d.features(t)[0] for t in part]
            marks += [mark] * len(part)
    y = np.array(marks)
    weight = np.array([counts[m] for m in (0, 1)])[y] / np.bincount(y)[y]
    return Model(Distance(toxic, ordinary), np.array(rows), y.astype(float), weight / weight.mean())


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and n_windows of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            out = [(m, len(windows(t))) if isinstance(m, float) else m.score(t) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([n for _, n in out], pa.int64())],
                names=["doc_id", "score", "n_windows"])

    return rows.mapInArrow(work, "doc_id long, score double, n_windows long")
