"""Language identification by nearest centroid.

Character 1- to 3-grams of the letters are hashed into a fixed number of
dimensions, weighted by sublinear TF (a power under one, so that the greater part of a mixed
text weighs more) and by IDF, and normalised. Each language
has several centroids (spherical k-means); a text takes the language of the
centroid with the largest cosine. A text is *rejected* when it has no letter or
when its cosine stays under the floor for texts of its size (distinct n-grams, by
powers of two): ``REJECT`` times a low quantile of the cosines of sampled texts
that the clustering did not see.

Document frequencies cover every training row (one distributed pass). Only the
centroids are fitted on a sample: ``sample`` rows in all, divided evenly between
languages, at least one row of each, those of the least hashes. The model takes
16 KB a centroid; over ``MANY`` languages raise an error.

Edge cases: a null text, an empty text and a text without letters give ``und``
with score 0 and are rejected. With no training rows (an empty table too) every
text gives ``und``, score 0, and nothing but letterless text is rejected. Rows
with a null language are not learned from. Repeated rows each get their own,
equal, prediction. Ties between centroids go to the alphabetically first
language. Texts are read whole at any length. ``identify`` replaces columns of
the caller that are named like its own three; ``accepted`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agreemill.llm.common import col, fold, free_name, small_batches

UNKNOWN = "und"
DIMS = 4096
CENTROIDS = 6
REJECT = 0.65
QUANTILE = 0.01
HELD = 5
TF_POWER = 0.75
SAMPLE = 2400
CHUNK = 128
MANY = 20_000

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams, or None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    c = np.empty(int(keep.sum()) + 2, np.uint32)
    c[0] = c[-1] = 0
    c[1:-1] = codes[keep]
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    one = (c[1:-1] + np.uint32(0x51ED)) * np.uint32(0x9E3779B1)
    two = (c[:-1] * np.uint32(0x85EBCA6B) + c[1:]) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
    hashed = np.concatenate([one, two, (three ^ (three >> np.uint32(13))) * np.uint32(0x9E3779B1)]) >> shift
    return np.bincount(hashed.astype(np.intp), minlength=dims)


def sublinear(counts: np.ndarray) -> np.ndarray:
    return np.power(counts, TF_POWER, dtype=np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(np.einsum("...i,...i->...", rows, rows))[..., None], 1e-12)


@dataclass
class Model:
    """Fitted centroids; its size depends on the number of languages alone."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text, in order."""
        for at in range(0, len(texts), CHUNK):
            found = [grams(t, len(self.idf)) for t in texts[at : at + CHUNK]]
            real = [i for i, g in enumerate(found) if g is not None]
            out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(found)
            if real and self.languages:
                counts = np.stack([found[i] for i in real])
                near = unit(sublinear(counts) * self.idf) @ self.centroids.T
                best = near.argmax(axis=1)
                for i, j, cosine, size in zip(real, best, near.max(axis=1), _size_class(counts), strict=True):
                    score = float(min(1.0, max(0.0, cosine)))
                    out[i] = (self.languages[self.owner[j]], score, bool(score < self.floors[size]))
            elif real:
                for i in real:
                    out[i] = (UNKNOWN, 0.0, False)
            yield from out


def _size_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(15, np.log2(np.maximum(1, (counts > 0).sum(axis=1))).astype(int))


def _floors(best: np.ndarray, sizes: np.ndarray, reject: float) -> np.ndarray:
    """Floors by size class, never falling with size. A class without rows takes the
    floor of the nearest smaller one, or 0."""
    floors = np.zeros(16)
    for s in range(16):
        seen = best[sizes == s]
        floors[s] = reject * np.quantile(seen, QUANTILE) if len(seen) else (floors[s - 1] if s else 0.0)
    return np.minimum.accumulate(floors[::-1])[::-1]


def fit_vectors(tf: np.ndarray, langs: list[str], idf: np.ndarray, k: int = CENTROIDS, reject: float = REJECT) -> Model:
    """Cluster sublinear TF rows of each language into ``k`` centroids.

    Every ``HELD``-th row of a language sets the floors and is not clustered.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(0, int), np.zeros((0, len(idf)), np.float32), idf, np.zeros(16))
    rows = unit(tf * idf)
    at = {x: i for i, x in enumerate(names)}
    label = np.array([at[x] for x in langs])
    held = np.zeros(len(label), bool)
    owner, centroids = [], []
    for n in range(len(names)):
        own = np.flatnonzero(label == n)
        held[own[HELD - 1 :: HELD]] = True
        own = rows[own[~held[own]]]
        centres = own[np.linspace(0, len(own) - 1, min(k, len(own))).astype(int)]
        for _ in range(8):
            nearest = (own @ centres.T).argmax(axis=1)
            centres = unit(np.stack([own[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))]))
        owner += [n] * len(centres)
        centroids.append(centres)
    c = np.concatenate(centroids).astype(np.float32)
    floors = _floors((rows[held] @ c.T).max(axis=1), _size_class(tf[held]), reject) if held.any() else np.zeros(16)
    return Model(names, np.array(owner), c, idf.astype(np.float32), floors)


def idf_of(df_counts: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df_counts)) + 1).astype(np.float32)


def fit_texts(texts: list[str | None], langs: list[str], dims: int = DIMS) -> Model:
    """Fit on rows already at hand (a bounded sample of the caller)."""
    counts = [(g, x) for g, x in ((grams(t, dims), x) for t, x in zip(texts, langs, strict=True)) if g is not None]
    tf = sublinear(np.stack([g for g, _ in counts])) if counts else np.zeros((0, dims), np.float32)
    return fit_vectors(tf, [x for _, x in counts], idf_of((tf > 0).sum(axis=0), len(counts)))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts = grams(text.as_py())
            if counts is not None:
                total += counts > 0
                n += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], n))], ["bucket", "df"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(x.as_py()) for x in batch.column(1)]
        packed = [None if g is None else np.minimum(sublinear(g), 60_000).astype(np.float16).tobytes() for g in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["id", "lang", "tf"])


def fit(learn: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on ``learn``: IDF over all its rows, centroids on about ``sample``."""
    small_batches()
    rows = learn.select(col(text).alias("t"), col(lang).alias("l"), col(key).alias("k")).where(F.col("l").isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MANY + 1).collect()}
    if len(sizes) > MANY:
        raise ValueError(f"over {MANY} languages")
    df_counts, n = np.zeros(DIMS, np.int64), 0
    for r in rows.select("t").mapInArrow(_document_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        if r["bucket"] < 0:
            n = r["df"]
        else:
            df_counts[r["bucket"]] = r["df"]
    if not sizes:
        return fit_vectors(np.zeros((0, DIMS), np.float32), [], idf_of(df_counts, n))
    each = max(1, sample // len(sizes))
    share = F.create_map(*[F.lit(x) for lang_, size in sizes.items() for x in (lang_, min(1.0, (2 * each + 20) / size))])
    drawn = F.pmod(F.xxhash64(F.col("k"), F.lit("langid")), F.lit(1_000_003)) / 1_000_003.0
    likely = rows.withColumn("drawn", drawn).where(F.col("drawn") < share[F.col("l")])
    first = F.row_number().over(Window.partitionBy("l").orderBy("drawn", "k", F.xxhash64("t")))
    picked = likely.withColumn("first", first).where(F.col("first") <= each)
    got = picked.select(F.col("k").cast("string").alias("id"), "t", "l").mapInArrow(_vectors, "id string, lang string, tf binary").collect()
    got = sorted((r for r in got if r["tf"] is not None), key=lambda r: (r["lang"], r["id"] or ""))
    tf = np.stack([np.frombuffer(r["tf"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, DIMS), np.float32)
    return fit_vectors(tf, [r["lang"] for r in got], idf_of(df_counts, n))


def predict(model: Model, text: Column) -> Column:
    """struct(lang, score, rejected) of a text column."""
    small_batches()
    shared = _Shared(model)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.get()
        for batch in batches:
            rows = list(own.predict(batch.to_pylist()))
            parts = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.float64()), pa.array(parts[2], pa.bool_())], ["lang", "score", "rejected"])

    return identify(text)


class _Shared:
    """A model as a broadcast; its size is bounded by MANY languages."""

    def __init__(self, model: Model):
        from pyspark import SparkContext

        self.sent = SparkContext.getOrCreate().broadcast(model)

    def get(self) -> Model:
        return self.sent.value


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``, which replace columns of these names."""
    name = free_name(docs, "langid")
    new = {"lang_pred": "lang", "score": "score", "rejected": "rejected"}
    kept = [col(c) for c in docs.columns if c.lower() not in new]
    return docs.withColumn(name, predict(model, col(text))).select(*kept, *[F.col(name)[v].alias(k) for k, v in new.items()])


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are near a language learned from the labelled ones."""
    name = free_name(docs, "langid")
    found = docs.withColumn(name, predict(fit(docs, text, lang), col(text)))
    return found.where(~F.col(name)["rejected"]).select(*[col(c) for c in docs.columns])


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """The op2 query: learn off the fold whose remainder is 1, predict all."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.where(fold(F.col("doc_id"), 3) != 1))
    found = identify(rows.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
