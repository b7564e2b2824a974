"""Language ID by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; each bit has a binary classifier, logistic in the mean weight of the
text's 1-, 2- and 4-grams. A text's language is the codeword with the least loss, each bit's loss
weighted by how reliable its classifier was in training; the score is the share of the chosen
codeword when losses are taken as logarithms, and a small lead over the next one marks the text as
ambiguous.

Training takes a bounded sample: of each language the `per_language` labelled rows (default 300) with
the least hash of key and text; hashes alone are ranked, and of equal rows one trains. Predictions read the whole text and nothing else. A null text, or one without a
letter, is `und` with score 0; with no labelled rows every text is. Null labels do not train. Empty
tables give empty results; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textops import pieces

ORDERS = ((1, 256), (2, 2048), (4, 8192))  # n-gram length, buckets
DIMS = sum(b for _, b in ORDERS)
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 or c == 39 else 48 if 48 <= c <= 57 else 32 for c in range(256)], np.uint32)


def gram_ids(data: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each byte."""
    x, out, base = _FOLD[data], [], 0
    for n, buckets in ORDERS:
        if len(x) < n:
            out.append(np.zeros(0, np.int64))
        elif n == 1:
            out.append(x.astype(np.int64) + base)
        else:
            h = np.zeros(len(x) - n + 1, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) + x[i : len(x) - n + 1 + i]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append(((h >> np.uint32(7)) % np.uint32(buckets)).astype(np.int64) + base)
        base += buckets
    return out


def codewords(n: int, bits: int) -> np.ndarray:
    """n codewords of +-1, far apart: of random ones, each next has the largest least distance to those chosen."""
    rng = np.random.default_rng(11)
    pool = rng.integers(0, 2, (4096, bits)) * 2 - 1
    chosen = [0]
    far = (pool != pool[0]).sum(1)
    while len(chosen) < n:
        k = int(far.argmax())
        chosen.append(k)
        far = np.minimum(far, (pool != pool[k]).sum(1))
    return pool[chosen]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, ends in pieces(batch, "_text"):
            ids = gram_ids(data)
            where, counts = [], []
            for a, b in zip(ends[:-1], ends[1:]):
                x = np.concatenate([np.bincount(g[a : max(a, b - n + 1)], minlength=DIMS) / max(1, b - n + 1 - a) for g, (n, _) in zip(ids, ORDERS)]).reshape(len(ORDERS), DIMS).sum(0)
                w = np.flatnonzero(x)
                where.append(w.astype(np.int32).tobytes())
                counts.append(x[w].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("_lang"), pa.array(where, pa.binary()), pa.array(counts, pa.binary())], ["_lang", "at", "x"])


class LanguageModel:
    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.codes, self.weights, self.bias, self.trust = languages, codes, weights, bias, trust

    @classmethod
    def fit(cls, docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", where: Column | None = None, per_language: int = 300, steps: int = 250) -> LanguageModel | None:
        """Learns from labelled rows; None if there are none."""
        rows = docs.where(where) if where is not None else docs
        rows = rows.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"), F.xxhash64(F.col(key), F.col(text)).alias("_h")).where("_lang is not null and length(_text) > 0")
        # Rows are chosen by their hashes; their texts, at most per_language for each language, never shuffle.
        best = rows.select("_lang", "_h").withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).where(F.col("_n") <= per_language)
        most = best.groupBy("_lang").agg(F.max("_h").alias("_most"))
        chosen = rows.join(F.broadcast(most.withColumnRenamed("_lang", "_of")), (F.col("_lang") == F.col("_of")) & (F.col("_h") <= F.col("_most")))
        got = chosen.dropDuplicates(["_lang", "_h"]).select("_lang", "_text").mapInArrow(_features, "_lang string, at binary, x binary").collect()
        if not got:
            return None
        got.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
        languages = sorted({r[0] for r in got})
        codes = codewords(len(languages), max(8, min(31, 2 * len(languages) + 7)))
        x = np.zeros((len(got), DIMS), np.float32)
        for i, r in enumerate(got):
            x[i, np.frombuffer(r[1], np.int32)] = np.frombuffer(r[2], np.float32)
        scale = 1 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-7)
        x *= scale
        sizes = np.einsum("ij,ij->i", x, x)
        label = np.array([languages.index(r[0]) for r in got])
        share = 1 / np.bincount(label)[label]
        share /= share.sum()
        y = codes[label].astype(np.float32)
        w, b = np.zeros((DIMS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
        norm = float((share * sizes).sum())  # bounds the curvature, so that the step is safe
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            pull = (share[:, None] * y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))).astype(np.float32)
            vw = 0.9 * vw + x.T @ pull * (8 / norm) - 1e-5 * w
            vb = 0.9 * vb + pull.sum(0)
            w, b = w + vw, b + vb * 0.1
        right = ((y * (x @ w + b) > 0) * share[:, None]).sum(0)
        return cls(languages, codes, w * scale[:, None], b, np.clip(2 * right - 1, 0.05, 1))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language's number, its score, and whether the next is close."""
        loss = np.stack([(self.trust * np.logaddexp(0, -c * margins)).sum(1) for c in self.codes], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return p.argmax(1), top[:, -1], (top[:, -1] - top[:, -2] < 0.2 if len(self.codes) > 1 else np.zeros(len(p), bool))

    def predict(self, docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
        """See identified()."""
        model, cols = self, docs.columns
        flat = docs.select(*(F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(cols)))
        at, inner = f"c_{cols.index(text)}", flat.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                letters = pc.fill_null(pc.match_substring_regex(batch.column(at), r"\pL"), False)
                batch = batch.append_column("_letters", letters)
                for part, data, ends in pieces(batch, at, 1 << 18):
                    margins = np.tile(model.bias, (part.num_rows, 1))
                    for ids, (n, _) in zip(gram_ids(data), ORDERS):
                        for step in range(0, len(ids), 1 << 18):  # a long text goes through in bounded steps
                            got = ids[step : step + (1 << 18)]
                            a, b = np.clip(ends[:-1] - step, 0, len(got)), np.clip(ends[1:] - n + 1 - step, 0, len(got))
                            some = np.flatnonzero(b > a)
                            if len(some):
                                w = model.weights[got]
                                w = np.concatenate([w, np.zeros((1, w.shape[1]), w.dtype)])
                                cuts = np.stack([a[some], b[some]], 1).ravel()
                                margins[some] += np.add.reduceat(w, cuts, 0, dtype=np.float64)[::2] / np.maximum(1, ends[1:] - ends[:-1] - n + 1)[some, None]
                    best, score, close = model.decide(margins)
                    ok = part.column("_letters").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], pa.array([model.languages[k] if o else "und" for k, o in zip(best, ok)], pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(close & ok)],
                        [*inner, "lang_pred", "score", "ambiguous"],
                    )

        form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields)
        out = flat.mapInArrow(run, f"{form}, lang_pred string, score double, ambiguous boolean")
        return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(cols) if c in _kept(cols, prefix)), *(F.col(c).alias(prefix + c) for c in OUT))


OUT = ("lang_pred", "score", "ambiguous")


def _kept(columns: list[str], prefix: str) -> list[str]:
    return [c for c in columns if c.lower() not in {prefix.lower() + o for o in OUT}]


def identified(docs: DataFrame, model: LanguageModel | None, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with {prefix}lang_pred, {prefix}score and {prefix}ambiguous, which replace columns of these names; without a model all are `und`."""
    if model is None:
        values = zip(OUT, (F.lit("und"), F.lit(0.0), F.lit(False)))
        return docs.select(*(F.col(f"`{c}`") for c in _kept(docs.columns, prefix)), *(v.alias(prefix + o) for o, v in values))
    return model.predict(docs, text, prefix)
