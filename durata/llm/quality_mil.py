"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (the last may be shorter).
Every passage is encoded: byte-class shares, word lengths, repeated words and
windows, and hashed word shapes, then one tanh layer.  Gated attention gives
each passage a weight (softmax over the document of w . (tanh(V e) *
sigmoid(U e))); the weighted sum of the encodings goes through a logistic
output.  Only document labels are used; the attention finds the passages that
matter.

Training takes at most TRAIN_DOCS labelled documents, those of least hash, as
whole texts; scoring covers every passage of every document.

Defined results: null and empty texts are one passage without words and get a
score too; repeated rows get the same score; an empty table gives an empty
table; without labels of both classes the score is their mean (0.5 without
any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from durata.llm.hashing import SPACED, Words, blocks, gram_hashes, utf8

PASSAGE = 64
TRAIN_DOCS = 3_000
EPOCHS = 12
ENCODING, ATTENTION = 24, 12
SHAPES = 16
_U = np.uint64
#: byte class of every byte; 0 is the rest
_CLASSES = [range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b"#*$%&|<>", b"!?", b".,;:", b"\n", b" \t\r\x0b\x0c",
            range(0x80, 0x100), b"'\"()-", b"@/\\_=+{}[]~^`"]


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for k, members in enumerate(_CLASSES, 1):
        t[list(members)] = k
    return t


_CLASS = _class_table()
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = N_CLASSES + 6 + SHAPES


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows) and the first passage of each text,
    with the total at the end.  A text has one passage at least."""
    w = Words(texts, SPACED)
    n_docs = len(texts)
    per_doc = np.maximum(1, -(-w.count // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    total = int(first[-1])
    in_doc = np.arange(len(w.doc)) - w.first[w.doc]
    passage = first[w.doc] + in_doc // PASSAGE
    # a passage's bytes run from its first word to the next passage or text
    heads = np.flatnonzero(in_doc % PASSAGE == 0)
    start = w.base[:-1].repeat(per_doc).astype(np.int64)
    start[passage[heads[in_doc[heads] > 0]]] = w.start[heads[in_doc[heads] > 0]]
    size = np.diff(np.append(start, w.base[-1]))
    of_byte = np.repeat(np.arange(total, dtype=np.int64) << 4, size)
    cls = _CLASS[np.frombuffer(w.buf, np.uint8)]
    counts = np.bincount(of_byte | cls, minlength=total << 4).reshape(total, 16)[:, :N_CLASSES].astype(np.float32)
    # the separator after each text is no part of it
    counts[first[1:] - 1, 7] -= 1
    words = np.bincount(passage, minlength=total).astype(np.float32)
    length = (w.end - w.start).astype(np.float32)
    one = np.maximum(words, 1)
    mean = np.bincount(passage, length, total) / one
    square = np.bincount(passage, length * length, total) / one
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    twice = np.bincount(passage, _seen(w.hash, w.doc), total) / one
    grams = gram_hashes(w.hash, 4)
    again = np.zeros(len(w.doc), np.float32)
    if len(grams):
        inside = w.doc[:len(grams)] == w.doc[3:]
        again[:len(grams)] = _seen(grams, w.doc[:len(grams)]) * inside
    again = np.bincount(passage, again, total) / one
    # signed shape buckets: last byte class and length of each word, hashed
    last = _CLASS[np.frombuffer(w.buf, np.uint8)[w.end - 1]].astype(np.int64) if len(w.end) else np.zeros(0, np.int64)
    shape = (last * 7 + np.minimum(w.end - w.start, 15) // 3) % SHAPES
    shapes = np.bincount(passage * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES) / one[:, None]
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    x = np.column_stack([share, mean / 10, spread / 10, twice, again, words / PASSAGE, np.log1p(words) / 5, shapes])
    return x.astype(np.float32), first


def _seen(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1 where a hash stood earlier in the same document."""
    out = np.zeros(len(h), np.float32)
    if len(h):
        key = h ^ (doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        s = key[order]
        out[order[1:][s[1:] == s[:-1]]] = 1
    return out


class Attention:
    """Gated-attention bag classifier."""

    NAMES = ("E", "eb", "V", "vb", "U", "ub", "w", "c", "cb")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"E": init(N_FEATURES, ENCODING), "eb": np.zeros(ENCODING), "V": init(ENCODING, ATTENTION),
                  "vb": np.zeros(ATTENTION), "U": init(ENCODING, ATTENTION), "ub": np.zeros(ATTENTION),
                  "w": r.normal(0, 0.1, ATTENTION), "c": r.normal(0, 0.1, ENCODING), "cb": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        e = np.tanh(x @ p["E"] + p["eb"])
        v, u = np.tanh(e @ p["V"] + p["vb"]), 1 / (1 + np.exp(-(e @ p["U"] + p["ub"])))
        g = (v * u) @ p["w"]
        lo, n = first[:-1], np.diff(first)
        a = np.exp(g - np.repeat(np.maximum.reduceat(g, lo), n))
        a /= np.repeat(np.add.reduceat(a, lo), n)
        z = np.add.reduceat(a[:, None] * e, lo, axis=0)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["cb"])))
        return {"x": x, "e": e, "v": v, "u": u, "a": a, "z": z, "y": y, "n": n, "lo": lo}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"] if len(first) > 1 else np.zeros(0)

    def _gradients(self, f: dict, target: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        dy = (f["y"] - target) * weight / weight.sum()
        dz = dy[:, None] * p["c"]
        dzr = np.repeat(dz, f["n"], axis=0)
        da = (dzr * f["e"]).sum(axis=1)
        dg = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["lo"]), f["n"]))
        dvu = dg[:, None] * p["w"]
        dv = dvu * f["u"] * (1 - f["v"] ** 2)
        du = dvu * f["v"] * f["u"] * (1 - f["u"])
        de = (f["a"][:, None] * dzr + dv @ p["V"].T + du @ p["U"].T) * (1 - f["e"] ** 2)
        return {"E": f["x"].T @ de, "eb": de.sum(0), "V": f["e"].T @ dv, "vb": dv.sum(0), "U": f["e"].T @ du,
                "ub": du.sum(0), "w": (f["v"] * f["u"]).T @ dg, "c": f["z"].T @ dy, "cb": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Attention:
        """Adam over mini-batches of documents; both classes weigh alike up
        to a factor of 4."""
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        share = np.clip(target.mean(), 0.2, 0.8)
        weight = np.where(target > 0, 1 / share, 1 / (1 - share))
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            order = r.permutation(len(target))
            for lo in range(0, len(order), 256):
                part = order[lo:lo + 256]
                sizes = first[part + 1] - first[part]
                ends = np.cumsum(sizes)
                rows = np.repeat(first[part] - ends + sizes, sizes) + np.arange(ends[-1])
                f = self.forward(x[rows], np.concatenate([[0], ends]))
                step += 1
                for k, g in self._gradients(f, target[part], weight[part]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def sample(docs: DataFrame, labels: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "label") -> DataFrame:
    """(text, label, h) of the ``limit`` labels of least hash (all if fewer).
    The choice looks at ids alone; the chosen labels, ``limit`` rows at most,
    are broadcast, so no text is shuffled for it."""
    chosen = (labels.filter(F.col(label_col).isNotNull())
              .select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("label"),
                      F.xxhash64(F.col(id_col).cast("string")).alias("h"))
              .orderBy("h", "__id").limit(limit))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("text", "label", "h")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
          limit: int = TRAIN_DOCS):
    """The model of at most ``limit`` labelled documents; their passages'
    features are what reaches the driver.  Returns an Attention, or a number
    if there is but one class."""
    rows = sample(docs, labels, limit, id_col, text_col, label_col).select("text", "label", "h")

    def work(batches):
        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in blocks(texts):
                x, first = encode_passages(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[first[i]:first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()),
                     b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)], names=["x", "label", "h"])

    got = sorted((r.h, bytes(r.x), r.label) for r in rows.mapInArrow(work, "x binary, label double, h long").collect())
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, x, _ in got]
    target = np.array([y for _, _, y in got])
    if not len(target):
        return 0.5
    if target.min() == target.max():
        return float(target.mean())
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Attention().fit(np.concatenate(bags), first, target)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_passages and top_passage (the one of most weight)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in blocks(texts):
                x, first = encode_passages(texts[lo:hi])
                if isinstance(m, float):
                    y, top = np.full(hi - lo, m), np.zeros(hi - lo, np.int64)
                else:
                    f = m.forward(x, first)
                    y = f["y"]
                    best = np.repeat(np.maximum.reduceat(f["a"], f["lo"]), f["n"])
                    place = np.arange(len(x)) - np.repeat(f["lo"], f["n"])
                    top = np.minimum.reduceat(np.where(f["a"] == best, place, len(x)), f["lo"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(y.astype(np.float64)),
                     pa.array(np.diff(first).astype(np.int64)), pa.array(top.astype(np.int64))],
                    names=["doc_id", "score", "n_passages", "top_passage"])

    return rows.mapInArrow(work, "doc_id long, score double, n_passages long, top_passage long")
