"""Language identification by nearest centroid.

A text is a vector of character n-grams (one to three characters of its lower-case
letters, words apart by one blank), hashed into ``DIM`` places, weighted by TF-IDF and
normalised. Every language has several centroids, found by spherical k-means over its
training vectors. A text gets the language of the centroid with the largest cosine.

Document frequencies are counted over all training rows. Centroids are fitted on a
sample of ``SAMPLE`` rows expected per language, chosen by a hash of id and text; rows
that repeat both are one with their number.

A text is rejected when its distance from the nearest centroid is beyond what training
texts of like length have: its cosine is below 0.4 of what all but a thousandth of them
reach. All training rows count for that. Lengths with few of them take half the floor of
the next longer ones, the longest count with the next shorter ones; a language with few
texts of any length takes half of what they reach together. A null text or one without a letter is ``und``, has score 0 and is rejected.
With no training rows all texts are ``und``. Whole texts are read, in blocks. Rows
with null lang teach nothing; repeated rows are predicted each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 13
CLUSTERS = 4
SAMPLE = 2000
UNKNOWN = "und"
#: Bands of length for rejection: powers of four of the number of n-grams.
BANDS = 10
#: Training texts that a band needs for a floor of its own.
ENOUGH = 50
#: Steps of the cosine in which floors are counted.
STEPS = 1000
_CHUNK = 1 << 18
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(points: np.ndarray) -> np.ndarray:
    """Places of the n-grams of code points in which every non-letter is one blank."""
    p = points.astype(np.uint64)
    out = []
    for n, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        if len(p) < n:
            break
        key = p[: len(p) - n + 1].copy()
        for k in range(1, n):
            key = (key << np.uint64(21)) | p[k : len(p) - n + 1 + k]
        key = (key + np.uint64(n)) * np.uint64(salt)
        out.append(((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - DIM.bit_length() + 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def counts(text: str | None) -> np.ndarray | None:
    """How often each place is met in a whole text; None without a letter."""
    if not text:
        return None
    letters, total, carry = _letter_table(), None, np.zeros(0, np.uint32)
    for at in range(0, len(text), _CHUNK):
        part = text[at : at + _CHUNK].lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(letters[points], points, np.uint32(32))
        points = np.concatenate([carry if at else np.array([32], np.uint32), points, np.array([32] if at + _CHUNK >= len(text) else [], np.uint32)])
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        found = np.bincount(_grams(points), minlength=DIM)
        if at:  # the two points carried over were counted before
            found -= np.bincount(_grams(carry), minlength=DIM)
        total = found if total is None else total + found
        carry = points[-2:]
    blank = _grams(np.array([32], np.uint32))[0]
    total[blank] = 0
    return total if total.any() else None


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of every centroid
    floors: np.ndarray  # least cosine by centroid and band


def _vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.array(rows, dtype=np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _band(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)) // 2, BANDS - 1).astype(int)


def _batched(column, size: int = 256) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows with letters and their counts, some at a time."""
    at, rows = [], []
    for i, text in enumerate(column):
        if (c := counts(text.as_py() if isinstance(text, pa.Scalar) else text)) is not None:
            at.append(i)
            rows.append(c)
            if len(rows) == size:
                yield at, rows
                at, rows = [], []
    if rows:
        yield at, rows


def _fit_language(idf: np.ndarray, clusters: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        found = [(_vectors(rows, idf), frame["mass"].to_numpy()[at]) for at, rows in _batched(frame["text"])]
        names = {"lang": "object", "cluster": "int32", "centroid": "object"}
        if not found:
            return pd.DataFrame({k: pd.Series(dtype=t) for k, t in names.items()})
        x, mass = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])[:, None].astype(np.float32)
        k = min(clusters, len(x))
        # spread starting points: each the row farthest from those before it
        picked = [int(np.argmax(x @ ((x * mass).sum(axis=0) / mass.sum())))]
        near = x @ x[picked[0]]
        for _ in range(k - 1):
            picked.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[picked[-1]])
        centres = x[picked]
        for _ in range(12):
            of = np.argmax(x @ centres.T, axis=1)
            centres = np.array([(x * mass)[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(k)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        lang = frame["lang"].iloc[0]
        return pd.DataFrame({"lang": [lang] * k, "cluster": range(k), "centroid": [c.tolist() for c in centres]}).astype({"cluster": "int32"})

    return run


def _cosines(model: Model):
    """How often training texts of each language and band reach each step of the cosine."""
    own = {k: np.array([c == k for c in model.langs]) for k in model.langs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = {k: np.zeros((BANDS, STEPS + 1), dtype=np.int64) for k in own}
        for batch in batches:
            taught = np.array(batch.column(0).to_pylist(), dtype=object)
            for at, rows in _batched(batch.column(1)):
                near, bands, langs = _vectors(rows, model.idf) @ model.centroids.T, _band(np.array([r.sum() for r in rows])), taught[at]
                for k in own.keys() & set(langs):
                    of = langs == k
                    steps = (np.clip(near[of][:, own[k]].max(axis=1), 0, 1) * STEPS).astype(int)
                    np.add.at(met[k], (bands[of], steps), 1)
        for k, n in met.items():
            band, step = np.nonzero(n)
            if len(band):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(band)), pa.array(band), pa.array(step), pa.array(n[band, step])], names=["lang", "band", "step", "n"])

    return run


def floors_of(met: np.ndarray) -> np.ndarray:
    """The least cosine by band; met: training texts by band and step of the cosine."""
    reach = lambda n: 0.4 * int(np.searchsorted(np.cumsum(n), 0.001 * n.sum(), side="right")) / STEPS
    total, floors = met.sum(axis=1), np.zeros(BANDS)
    own = {b: met[b] for b in np.flatnonzero(total >= ENOUGH).tolist()}
    if own:
        top = max(own)
        found = {b: reach(n) for b, n in (own | {top: met[top:].sum(axis=0)}).items()}
    elif total.any():
        top = int(np.flatnonzero(total)[0])
        found = {top: 0.5 * reach(met.sum(axis=0))}
    else:
        return floors
    longer = found[top]
    for b in range(BANDS - 1, -1, -1):  # shorter texts never have to be nearer than longer ones
        longer = min(longer, found[b]) if b in found else longer * 0.5 if b < top else longer
        floors[b] = longer
    return floors


def chosen_rows(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` different rows (key, text) of every language and how many each stands for."""
    of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in of.items()), F.lit(0.0))
    expected = F.col("n") * share
    picked = rows.groupBy("lang", "key").agg(F.count("*").alias("n")).where(F.pmod(F.col("key"), F.lit(1 << 30)) < F.least(expected, F.lit(1.0)) * (1 << 30))
    picked = F.broadcast(picked.select("lang", "key", F.greatest(expected, F.lit(1.0)).alias("mass")))  # about `sample` pairs of numbers per language
    return rows.join(picked, ["lang", "key"]).dropDuplicates(["lang", "key"])


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """The model held on the driver: ``clusters`` vectors of ``DIM`` numbers per language."""
    rows = train.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (c := counts(text.as_py())) is not None:
                    seen += c > 0
                    docs += 1
        place = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(seen[place[:-1]], docs))], names=["place", "n"])

    df = rows.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows
    found = {r.place: r.n for r in df}
    idf = np.array([np.log((1 + found.get(-1, 0)) / (1 + found.get(i, 0))) + 1 for i in range(DIM)], dtype=np.float32)

    chosen = chosen_rows(rows, sample)
    fitted = chosen.groupBy("lang").applyInPandas(_fit_language(idf, clusters), "lang string, cluster int, centroid array<float>").collect()
    fitted.sort(key=lambda r: (r.lang, r.cluster))
    langs = [r.lang for r in fitted]
    model = Model(idf, np.array([r.centroid for r in fitted], dtype=np.float32).reshape(-1, DIM), langs, np.zeros((len(langs), BANDS)))
    met = {k: np.zeros((BANDS, STEPS + 1), dtype=np.int64) for k in langs}
    if langs:
        reached = rows.select("lang", "text").mapInArrow(_cosines(model), "lang string, band long, step long, n long")
        for r in reached.groupBy("lang", "band", "step").agg(F.sum("n").alias("n")).collect():  # BANDS * STEPS rows of a language at most
            met[r.lang][r.band, r.step] = r.n
    floors = {k: floors_of(n) for k, n in met.items()}
    model.floors = np.array([floors[k] for k in langs]).reshape(-1, BANDS)
    return model


def _predicted(model: Model, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, cosine and acceptance of every text of an Arrow column."""
    n = len(column)
    lang, score, ok = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
    for at, rows in _batched(column) if model.langs else ():
        near = _vectors(rows, model.idf) @ model.centroids.T
        best = near.argmax(axis=1)
        value = near[np.arange(len(at)), best]
        lang[at] = [model.langs[b] for b in best]
        score[at] = np.clip(value, 0, 1)
        ok[at] = value >= model.floors[best, _band(np.array([r.sum() for r in rows]))]
    return lang, score, ok


def _predictor(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, ok = _predicted(model, batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(ok)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "accepted"],
            )

    return predict


def accepted(model: Model, text: Column) -> Column:
    """Whether the text is in a known language. Only the text is sent to Python; the other
    columns of a row stay where they are."""

    @F.arrow_udf("boolean")
    def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(_predicted(model, column)[2])

    return known(text.cast("string"))


def identify(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` (name to expression), lang_pred, score and accepted of every row."""
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text_col).cast("string").alias("text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predictor(model), f"{ddl}, lang_pred string, score double, accepted boolean")
