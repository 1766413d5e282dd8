"""Document vectors from text (T4x, T5x, T6x).

Default encoder, fully native: every sentence of the whole text (split on
". ") becomes a hashed bag of words (``HashingTF`` into ``dims``
buckets, L2-normalised); a document vector is the attention-style pooling
``sum_s softmax(salience_s) * v_s`` with salience = log(1 + tokens).  The
pooling is a weighted ``Summarizer`` mean per row, so rows that share an id
stay apart (partial aggregation, no window, no join, no collect).  The result is deterministic (no random
weights; the reference's untrained encoder is not reproducible, quirk Q19).

Pluggable encoder: ``embed(..., encoder=fn)`` runs ``fn(list[str]) ->
ndarray[n, dims]`` inside ``mapInPandas`` on Arrow batches (e.g. an ONNX
model loaded once per Python worker).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from .vectors import expand_columns


def summary_table(df: DataFrame, id_col: str, text_col: str, ids: DataFrame | None = None,
                  ids_col: str = "id") -> DataFrame:
    """T1x: id + text, optionally restricted to an id list, null text -> ''."""
    out = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    if ids is not None:
        out = out.join(ids.select(F.col(ids_col).alias(id_col)).distinct(), id_col, "left_semi")
    return out


def sentence_table(df: DataFrame, id_col: str, text_col: str, clean: bool = True,
                   max_sentences: int | None = None, max_tokens: int | None = None,
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """T4x: (id, sent_idx, sentence, tokens) for every sentence of the text.
    The caps of the reference's encoder (40 sentences, 32 tokens) are
    optional; by default the whole text is used."""
    t = TX.clean_text(text_col) if clean else F.coalesce(F.col(text_col), F.lit(""))
    sents = TX.sentences(t)
    if max_sentences:
        sents = F.slice(sents, 1, max_sentences)
    s = df.select(id_col, *extra, F.posexplode(sents).alias("sent_idx", "sentence"))
    toks = TX.tokens(F.lower("sentence"))
    if max_tokens:
        toks = F.slice(toks, 1, max_tokens)
    return s.withColumn("tokens", toks)


def _native(df: DataFrame, id_col: str, text_col: str, dims: int, clean: bool) -> DataFrame:
    rows = df.select(F.monotonically_increasing_id().alias("__row"), id_col, text_col)
    s = sentence_table(rows, id_col, text_col, clean, extra=("__row",))
    tf = HashingTF(inputCol="tokens", outputCol="__tf", numFeatures=dims, binary=False)
    s = Normalizer(inputCol="__tf", outputCol="__v", p=2.0).transform(tf.transform(s))
    # softmax pooling as a weighted mean: sum_s e^sal_s v_s / sum_s e^sal_s.
    # salience = log(1 + tokens) keeps e^sal = 1 + tokens, so no max-shift (and
    # no window) is needed: the pooling is a plain partial aggregation.
    s = s.withColumn("__w", F.exp(F.log1p(F.size("tokens").cast("double"))))
    pooled = s.groupBy("__row", id_col).agg(Summarizer.mean(F.col("__v"), F.col("__w")).alias("__doc"))
    return pooled.select(id_col, vector_to_array("__doc", "float32").alias("vector"))


def embed(df: DataFrame, id_col: str, text_col: str, dims: int = 256,
          encoder: Callable | None = None, clean: bool = True) -> DataFrame:
    """T5x: (id, vector array<float>) for every row; empty text -> zero vector."""
    if encoder is None:
        return _native(df, id_col, text_col, dims, clean)
    src = df.select(id_col, (TX.clean_text(text_col) if clean else F.col(text_col)).alias("__t"))
    id_type = src.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            v = np.asarray(encoder(pdf["__t"].fillna("").tolist()), dtype="float32")
            yield pd.DataFrame({id_col: pdf[id_col], "vector": list(v)})

    return src.mapInPandas(run, schema=f"{id_col} {id_type}, vector array<float>")


def expand(df: DataFrame, vec_col: str = "vector", dims: int = 256, prefix: str = "brief_han_") -> DataFrame:
    """T6x: one float column per dimension (Spark has no half float)."""
    keep = [c for c in df.columns if c != vec_col]
    return df.select(*keep, *expand_columns(vec_col, dims, prefix))
