"""Toxicity scores by weak supervision.

1. Voters. Words and word beginnings that mark toxic documents among the labelled
   rows, and a fixed list of insults, are dealt to lexicon voters; pattern voters look
   at how many marked words a text has and how dense they are. A voter says yes or no.
2. Label model. How often each pattern of votes occurs is counted over all documents.
   Expectation-maximisation over this histogram estimates, for toxic and clean texts,
   how often each voter says yes. Votes that go together within a class are found by
   their correlation there, and each voter counts the less the more it repeats others.
3. Classifier. Logistic regression on the marked words of a sample of documents learns
   the label model's posterior; it scores every whole text.

Only labelled rows outside the held-out fold give labels, at most about ``LABELLED`` of
them, chosen by hash; the classifier takes about ``SAMPLE`` documents outside the fold.
Labels, lang, source and doc_id never enter a score. A null or empty text has no marks
and gets the classifier's constant. Several labels of a document count by majority, null
ones not at all. Without labelled rows the list of insults alone votes. An empty table
gives an empty one. Rows with a null id are scored and never learned from.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.text import mix, word_hashes
from tallyhouse.session import materialize

LABELLED = 40_000
SAMPLE = 40_000
#: Marked words and beginnings at most.
MARKS = 4000
LEXICONS = 6
_CHUNK = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
#: Common insults.
INSULTS = (
    "idiot moron stupid dumb loser trash garbage scum worthless pathetic disgusting clown imbecile fool freak jerk creep coward "
    "crap shit fuck bitch bastard asshole whore slut dickhead retard"
).split()


def features(text: str | None) -> tuple[set[str], int]:
    """The distinct words of a whole text with their beginnings of three to six letters,
    marked by a star; and the number of words."""
    words: set[str] = set()
    n, at, size = 0, 0, len(text or "")
    while at < size:  # a very long text part by part
        end = at + _CHUNK
        end = size if end >= size else (text.find(" ", end) + 1 or size)
        found = _WORD.findall(text[at:end].lower())
        words.update(found)
        n, at = n + len(found), end
    out = set(words)
    for k in (3, 4, 5, 6):
        out.update([w[:k] + "*" for w in words if len(w) >= k])
    return out, n


@dataclass
class Marks:
    """The place of every marked feature, and the lexicon voter of every place."""

    place: dict[str, int]
    voter: np.ndarray


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a text's three-word sequences: near copies mostly share it."""
    for batch in batches:
        hashes, counts = word_hashes(batch.column(0))
        keys = []
        for own in np.split(hashes, np.cumsum(counts)[:-1]):
            runs = mix(own[:-2] + mix(own[1:-1] + mix(own[2:]))) if len(own) > 2 else own
            keys.append(int(runs.min().view(np.int64)) if len(runs) else 0)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *batch.columns], names=["family", "text", "toxic"])


def find_marks(labelled: DataFrame, limit: int = MARKS) -> Marks:
    """labelled: text, toxic. The features that are toxic more often than chance allows
    among so many, in at least half of their texts; near copies count once."""
    once = labelled.select("text", "toxic").mapInArrow(_family, "family long, text string, toxic int")
    once = once.groupBy("family", "toxic").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (bad if toxic else good).update(features(text.as_py())[0])
                n[toxic] += 1
        for some, of in ((bad, 1), (good, 0)):
            names = [*some, None]
            numbers = pa.array([*some.values(), n[of]], pa.int64())
            nothing = pa.array([0] * len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *((numbers, nothing) if of else (nothing, numbers))], names=["feature", "bad", "good"])

    found = once.select("toxic", "text").mapInArrow(count, "feature string, bad long, good long")
    found = found.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = materialize(labelled.sparkSession, found, "features")
    whole = found.where("feature IS NULL").first()
    chosen = []
    if whole and whole.bad and whole.good:
        rate, many = whole.bad / (whole.bad + whole.good), found.count()
        n = F.col("bad") + F.col("good")
        share = F.col("bad") / n
        # bound of the chance to see so many toxic texts: exp(-n * divergence)
        clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
        weight = n * (share * F.log(share / rate) + clean)
        telling = found.where(F.col("feature").isNotNull() & (share >= max(0.5, 2 * rate if rate < 0.4 else 0.9))).withColumn("weight", weight)
        telling = telling.where(F.col("weight") > float(np.log(many)) + 5)
        chosen = [r.feature for r in telling.orderBy(F.desc("weight"), "feature").limit(limit).collect()]
    names = [*chosen, *(w for w in INSULTS if w not in chosen)]
    # a word and its beginnings share a voter
    voter = np.array([zlib.crc32(w[:3].encode()) % LEXICONS if i < len(chosen) else LEXICONS for i, w in enumerate(names)])
    return Marks({w: i for i, w in enumerate(names)}, voter)


def _marker(marks: Marks):
    keys = set(marks.place)
    insults = set(INSULTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, votes = [], []
            for text in batch.column(batch.num_columns - 1):
                found, n = features(text.as_py())
                hit = found & keys
                own = sorted(marks.place[w] for w in hit)
                bits = 0
                for v in set(marks.voter[own].tolist()):
                    bits |= 1 << v if v < LEXICONS else 0
                bits |= bool(hit & insults) << LEXICONS
                words = len({w for w in hit if w[-1] != "*"})
                bits |= (len(own) >= 2) << LEXICONS + 1 | (words >= 2) << LEXICONS + 2 | (200 * words > n) << LEXICONS + 3
                places.append(own)
                votes.append(bits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(places, pa.list_(pa.int32())), pa.array(votes, pa.int32())],
                names=[*batch.schema.names[:-1], "marks", "votes"],
            )

    return run


@dataclass
class LabelModel:
    prior: float
    yes: np.ndarray  # share of yes by class (clean, toxic) and voter
    weight: np.ndarray  # of each voter, less for those that repeat others

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        said = votes[:, None] >> np.arange(len(self.weight)) & 1
        clean, toxic = np.log(self.yes), np.log(1 - self.yes)
        ratio = np.where(said, clean[1] - clean[0], toxic[1] - toxic[0])
        logit = np.log(self.prior / (1 - self.prior)) + ratio @ self.weight
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit_labels(votes: np.ndarray, seen: np.ndarray, labelled: np.ndarray, rounds: int = 30) -> LabelModel:
    """votes: patterns; seen: texts without a label of each; labelled: labelled texts of
    each, clean and toxic. Expectation-maximisation with correlated voters."""
    m = LEXICONS + 4
    said = (votes[:, None] >> np.arange(m) & 1).astype(float)
    start = np.tile(np.array([[0.01], [0.3]]), (1, m))
    of = labelled.sum(axis=0)
    yes = (labelled.T @ said + 2 * start) / (of[:, None] + 2)
    prior = float((of[1] + 1) / (of.sum() + 10))
    model = LabelModel(prior, np.clip(yes, 1e-4, 1 - 1e-4), np.ones(m))
    for _ in range(rounds):
        p = model.posterior(votes)
        mass = np.stack([seen * (1 - p) + labelled[:, 0], seen * p + labelled[:, 1]])
        total = mass.sum(axis=1)
        yes = (mass @ said + 2 * start) / (total[:, None] + 2)
        together = np.zeros((m, m))
        for k in (0, 1):
            centred = said - yes[k]
            cov = (centred * mass[k][:, None]).T @ centred / max(total[k], 1)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            together += 0.5 * np.clip(cov / np.outer(spread, spread), 0, 1) * (total[k] > 0)
        np.fill_diagonal(together, 1.0)
        model = LabelModel(float(np.clip((total[1] + 1) / (total.sum() + 10), 1e-3, 0.5)), np.clip(yes, 1e-4, 1 - 1e-4), 1 / together.sum(axis=1))
    return model


def fit_classifier(
    rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 400, ridge: float = 0.3, mass: np.ndarray | None = None
) -> np.ndarray:
    """Weights of the marks and, last, the constant: logistic regression on soft labels
    by accelerated gradient steps. ``mass``: how many texts each row stands for, else one."""
    mass = np.ones(len(rows)) if mass is None else mass
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    # features in many texts take shorter steps
    step = 1 / (0.25 * np.bincount(column, weights=mass[row], minlength=size) * max((len(r) for r in rows), default=1) + ridge)
    w = np.zeros(size + 1)
    seen, last = w.copy(), w.copy()
    for k in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights=seen[column], minlength=len(rows)) + seen[-1])))
        error = (p - target) * mass
        w = seen.copy()
        w[:-1] -= step * (np.bincount(column, weights=error[row], minlength=size) + ridge * seen[:-1])
        w[-1] -= 2.0 * error.sum() / mass.sum()
        seen = w + k / (k + 3) * (w - last)
        last = w
    return w


def score(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: Column,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3,
    labelled_rows: int = LABELLED, sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. ``held_out`` is an expression on
    a column ``doc_id``; its rows give neither labels nor training texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    taught = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    taught = taught.where(~held_out).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    share = min(1.0, labelled_rows / max(1, taught.count()))
    taught = taught.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    taught = F.broadcast(materialize(spark, taught, "labels"))  # about `labelled_rows` pairs of numbers

    marks = find_marks(rows.join(taught, "doc_id").select("text", "toxic"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.mapInArrow(_marker(marks), f"doc_id {kind}, held_out boolean, marks array<int>, votes int")
    marked = materialize(spark, marked, "votes")

    voted = marked.join(taught, "doc_id", "left").groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()  # by pattern of ten votes
    patterns = np.array(sorted({r.votes for r in voted}), dtype=np.int64)
    at = {v: i for i, v in enumerate(patterns.tolist())}
    seen, labelled = np.zeros(len(patterns)), np.zeros((len(patterns), 2))
    for r in voted:
        if r.toxic is None:
            seen[at[r.votes]] += r.n
        else:
            labelled[at[r.votes], r.toxic] += r.n
    model = fit_labels(patterns, seen, labelled)

    open_rows = marked.where("NOT held_out AND doc_id IS NOT NULL")
    total = open_rows.count()
    share = min(1.0, sample / max(1, total))
    # equal rows are one with their number; one that the share would take once or more is always taken
    keyed = open_rows.select("marks", "votes", F.xxhash64("marks", "votes").alias("key"))
    expected = F.count("*") * share
    picked = keyed.groupBy("key").agg(F.greatest(expected, F.lit(1.0)).alias("mass"), F.least(expected, F.lit(1.0)).alias("chance"))
    picked = F.broadcast(picked.where(F.pmod("key", F.lit(1 << 30)) < F.col("chance") * (1 << 30)).drop("chance"))  # about `sample` pairs of numbers
    chosen = keyed.join(picked, "key").groupBy("marks", "votes").agg(F.max("mass").alias("mass"))
    train = sorted((tuple(r.marks), r.votes, r.mass) for r in chosen.collect())  # about `sample` rows
    target = model.posterior(np.array([v for _, v, _ in train], dtype=np.int64))
    weights = fit_classifier([np.array(m, dtype=int) for m, _, _ in train], target, len(marks.place), mass=np.array([n for _, _, n in train]))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("marks")
            edge = np.concatenate(([0], np.cumsum(weights[own.flatten().to_numpy(zero_copy_only=False)])))
            sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))))
            logit = edge[sizes[1:]] - edge[sizes[:-1]] + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return marked.mapInArrow(classify, f"doc_id {kind}, held_out boolean, score double, predicted int")
