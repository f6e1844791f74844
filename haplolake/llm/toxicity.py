"""Convolutional text classifier for toxicity, trained by averaging over tasks.

A word's embedding is the sum of those of its hashed pieces: the word, its
beginnings and its end. Filters of one, two and three words run over the whole
text; each filter's maximum feeds a logistic output. Thresholds are calibrated
by language, and the language is guessed from the text itself.
"""

from __future__ import annotations

import copy
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.llm.common import Remember
from haplolake.llm.sampling import labelled_texts
from haplolake.session import scratch, stage

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 4, (1, 2, 3)
PIECES, COLUMNS = 5, 24  # of a word; numbers kept for a word: FILTERS for each place under each filter
EPOCHS, BATCH, BATCH_WORDS = 4, 32, 200_000
ROUNDS, TASK_ROWS = 3, 6000  # passes over all labelled rows, and rows of a task between two averages
WINDOWS = 8  # of a long text, where the fit is told to bound texts
BINS = 1024  # of a logit, where thresholds are chosen
MEMO = 150_000
CUT = 0.5

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "it", "was", "for", "with", "this", "from", "by", "are"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "von", "mit", "den", "dem", "ein", "eine", "auch", "sich"),
    "fr": ("le", "les", "et", "est", "une", "pour", "dans", "sur", "avec", "au", "du", "que", "pas", "aux"),
    "es": ("el", "los", "las", "y", "por", "con", "para", "una", "su", "del", "como", "esta", "lo", "al"),
}
_LANGUAGES = list(FUNCTION_WORDS)
_VOTE = {w: 1 + i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}
_WORD = re.compile(r"\w+")
PAD = 0  # stands between texts and behind short ones; no piece has it


def pieces(word: str) -> list[int]:
    """Buckets of the whole word, its first three, four and five characters, and its last four."""
    parts = (word, "<" + word[:3], "<" + word[:4], "<" + word[:5], word[-4:] + ">")
    return [1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for p in parts]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def language_of(votes: np.ndarray) -> int:
    """The language with the most function words; the number of languages if there is none."""
    counts = np.bincount(votes, minlength=len(_LANGUAGES) + 1)[1:]
    return int(counts.argmax()) if counts.any() else len(_LANGUAGES)


def tokens(text: str | None) -> tuple[np.ndarray, int]:
    """Pieces of every word, (words, PIECES), and the language of a whole text."""
    words = words_of(text)
    ids = np.array([_memo[w] for w in words], np.int64).reshape(-1, PIECES)
    return ids, language_of(np.array([_VOTE.get(w, 0) for w in words], np.int64))


_memo = Remember(pieces, 100_000)


@dataclass
class Network:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: np.ndarray
    output: np.ndarray
    offset: float
    cuts: np.ndarray  # logit at the threshold, by language

    def table(self) -> np.ndarray:
        """Each piece's share in the filters: COLUMNS numbers, by width and the word's place under the filter."""
        return np.concatenate([self.embedding @ self.filters[w][j] for w in WIDTHS for j in range(w)], 1).astype(np.float32)


def _log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the shares of toxic and clean documents that hold a bucket; ``counts`` is (2, BUCKETS)."""
    n = np.maximum(n, 1)
    ratio = np.log((counts[1] + 2) / (n[1] + 4)) - np.log((counts[0] + 2) / (n[0] + 4))
    ratio[counts.sum(0) == 0] = 0
    return ratio


class Trainer:
    """Parameters and their steps: stochastic gradient descent with adaptive steps.

    The first coordinate of each embedding starts at the bucket's log odds between
    the classes, the others at random; all are trained. Only the words at a
    filter's maximum get a gradient.
    """

    def __init__(self, odds: np.ndarray, rng: np.random.Generator):
        emb = rng.normal(0, 0.05, (BUCKETS, DIM))
        emb[:, 0] = odds
        emb[PAD] = 0
        filters = {w: rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS}
        for w in WIDTHS:
            filters[w][:, 0, :] += 0.5 / w
        k = FILTERS * len(WIDTHS)
        self.values = {"emb": emb, "bias": np.zeros(k), "out": np.full(k, 1.0 / k), "offset": np.zeros(1), **filters}
        self.speed = {name: np.full_like(v, 1e-6) for name, v in self.values.items()}

    def _moved(self, name, gradient, rate, rows=slice(None)) -> None:
        self.speed[name][rows] += gradient**2
        self.values[name][rows] -= rate * gradient / np.sqrt(self.speed[name][rows])

    def step(self, vocabulary: np.ndarray, docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """One step on a batch: documents are rows of ``vocabulary``, (words, PIECES); gives the buckets that moved."""
        v = self.values
        x = np.concatenate([v["emb"][vocabulary].sum(1), np.zeros((1, DIM))])
        pad = np.full(max(WIDTHS), len(vocabulary))
        flat = np.concatenate([*(part for d in docs for part in (d, pad)), pad])
        begins = np.cumsum([0] + [len(d) + len(pad) for d in docs[:-1]])
        tops, pooled = [], []
        for w in WIDTHS:
            last = len(flat) - len(pad)
            conv = sum((x @ v[w][j])[flat[j : j + last]] for j in range(w))
            # a window may begin on the one place behind the text
            top = np.stack([a + conv[a : a + len(d) + 1].argmax(0) for a, d in zip(begins, docs, strict=True)])
            tops.append(top)
            pooled.append(np.take_along_axis(conv, top, 0))
        pre = np.concatenate(pooled, 1) + v["bias"]
        hidden = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ v["out"] + v["offset"], -30, 30)))
        error = (p - y) / len(docs)
        back = error[:, None] * v["out"] * (pre > 0)
        self._moved("out", hidden.T @ error + 1e-4 * v["out"], 0.02)
        self._moved("bias", back.sum(0), 0.02)
        v["offset"] -= 0.1 * error.sum()
        grad, rows = np.zeros_like(x), []
        for i, w in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            step = np.zeros_like(v[w])
            for j in range(w):
                at = flat[tops[i] + j]  # (documents, filters)
                step[j] = np.einsum("dfc,df->cf", x[at], part)
                np.add.at(grad, at, part[:, :, None] * v[w][j].T[None])
                rows.append(at.ravel())
            self._moved(w, step, 0.02)
        used = np.unique(np.concatenate(rows))
        used = used[used < len(vocabulary)]
        buckets, where = np.unique(vocabulary[used].ravel(), return_inverse=True)
        total = np.zeros((len(buckets), DIM))
        np.add.at(total, where, np.repeat(grad[used], PIECES, axis=0))
        total[buckets == PAD] = 0
        self._moved("emb", total, 0.02, buckets)
        return buckets

    def network(self) -> Network:
        v = self.values
        return Network(v["emb"], {w: v[w] for w in WIDTHS}, v["bias"], v["out"], float(v["offset"][0]), np.zeros(len(_LANGUAGES) + 1))

    def rows(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbered rows of 2 * DIM numbers: embeddings and their speeds by bucket, all other numbers from -1 down."""
        rest = np.concatenate([a.ravel() for name in self.values if name != "emb" for a in (self.values[name], self.speed[name])])
        rest = np.pad(rest, (0, -len(rest) % (2 * DIM))).reshape(-1, 2 * DIM)
        own = np.concatenate([self.values["emb"][buckets], self.speed["emb"][buckets]], 1)
        return np.concatenate([buckets, -1 - np.arange(len(rest))]), np.concatenate([own, rest])

    def take(self, numbers: np.ndarray, rows: np.ndarray) -> None:
        """Set the parameters of such rows."""
        own = numbers >= 0
        self.values["emb"][numbers[own]], self.speed["emb"][numbers[own]] = rows[own, :DIM], rows[own, DIM:]
        rest, at = rows[~own][np.argsort(-numbers[~own])].ravel(), 0
        for name in self.values:
            for side in (self.values, self.speed):
                if name != "emb":
                    side[name] = rest[at : at + side[name].size].reshape(side[name].shape).copy()
                    at += side[name].size


def train(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Network of documents given as (words, PIECES), in one process."""
    rng = np.random.default_rng(seed)
    counts = np.zeros((2, BUCKETS))
    for ids, label in zip(docs, y, strict=True):
        counts[label, np.unique(ids)] += 1
    trainer = Trainer(_log_odds(counts, np.bincount(y, minlength=2)), rng)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for batch in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
            ends = np.cumsum([len(docs[i]) for i in batch])
            rows = [np.arange(end - len(docs[i]), end) for i, end in zip(batch, ends, strict=True)]
            trainer.step(np.concatenate([docs[i] for i in batch]), rows, y[batch])
    return trainer.network()


def logit(model: Network, shares: np.ndarray) -> float:
    """Output before the threshold, from the (words, COLUMNS) shares of a whole text."""
    n, at, pooled = len(shares), 0, []
    behind = np.concatenate([shares, np.zeros((max(WIDTHS), COLUMNS), np.float32)])
    for w in WIDTHS:
        conv = behind[: n + 1, at : at + FILTERS]
        for j in range(1, w):
            conv = conv + behind[j : j + n + 1, at + j * FILTERS : at + (j + 1) * FILTERS]
        pooled.append(conv.max(0))
        at += w * FILTERS
    return float(np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.output + model.offset)


class Scorer:
    """Scores texts with a bounded memo of the words' shares."""

    def __init__(self, model: Network, most: int = MEMO):
        self.model, self.table, self.most = model, model.table(), most
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.shares, self.vote = np.zeros((0, COLUMNS), np.float32), np.zeros(0, np.int64)

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.row) > self.most:
            self.forget()
        new = list({w for w in words if w not in self.row})
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            rows = self.table[np.array([pieces(w) for w in new])].sum(1)
            if len(self.row) > len(self.shares):
                room = max(len(self.row), 2 * len(self.shares))
                grown, votes = np.zeros((room, COLUMNS), np.float32), np.zeros(room, np.int64)
                grown[: len(self.shares)], votes[: len(self.vote)] = self.shares, self.vote
                self.shares, self.vote = grown, votes
            at = len(self.row) - len(new)
            self.shares[at : at + len(new)] = rows
            self.vote[at : at + len(new)] = [_VOTE.get(w, 0) for w in new]
        row = self.row
        return np.array([row[w] for w in words], np.int64)

    def logit(self, text: str | None) -> float:
        """Logit less the threshold of the text's language."""
        rows = self._rows(words_of(text))
        return logit(self.model, self.shares[rows]) - self.model.cuts[language_of(self.vote[rows])]


def _best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Logit that splits the classes with the fewest errors by class share, each row ``n`` times; the middle one of equals."""
    z, at = np.unique(z, return_inverse=True)
    bad, good = np.bincount(at, n * y), np.bincount(at, n * (1 - y))
    missed = np.concatenate([[0], np.cumsum(bad)]) / max(1, bad.sum())
    false = np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum())
    cost = missed + 1 - false
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    at = int(best[len(best) // 2])
    low, high = z[max(at - 1, 0)], z[min(at, len(z) - 1)]
    return float((low + high) / 2)


def _set_cuts(model: Network, z: np.ndarray, y: np.ndarray, n: np.ndarray, language: np.ndarray, least: int) -> Network:
    if len(set(y.tolist())) == 2:
        model.cuts[:] = _best_cut(z, y, n)
        for i in range(len(model.cuts)):
            own = language == i
            if np.bincount(y[own], n[own], minlength=2).min() >= least:
                model.cuts[i] = _best_cut(z[own], y[own], n[own])
    return model


def calibrate(model: Network, docs: list[np.ndarray], y: np.ndarray, language: np.ndarray, least: int = 25) -> Network:
    """Thresholds by language; languages with fewer than ``least`` documents of a class share the common one."""
    table = model.table()
    z = np.array([logit(model, table[d].sum(1)) for d in docs])
    return _set_cuts(model, z, y, np.ones(len(y)), language, least)


def bounded(text: str, most: int) -> Column:
    """The whole text, or evenly spread windows of a text of more than ``most`` characters; the first and last are its ends."""
    width = max(1, most // WINDOWS)
    starts = [F.floor((F.length(text) - width) * i / (WINDOWS - 1)).cast("int") + 1 for i in range(WINDOWS)]
    windows = F.concat_ws(" ", *(F.substring(text, at, F.lit(width)) for at in starts))
    return F.when(F.length(text) <= most, F.col(text)).otherwise(windows)


class _Words:
    """Rows of the words' pieces, with a bounded memo."""

    def __init__(self, most: int = MEMO):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.zeros((1024, PIECES), np.int32)

    def full(self) -> bool:
        return len(self.row) > self.most

    def rows(self, words: list[str]) -> np.ndarray:
        row = self.row
        for w in {w for w in words if w not in row}:
            if len(row) == len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[len(row)] = pieces(w)
            row[w] = len(row)
        return np.array([row[w] for w in words], np.int64)


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[str, int]]]]:
    """(text, y) of each run of rows of one task."""
    rows = ((t, text, y) for b in batches for t, text, y in zip(*(b.column(c).to_pylist() for c in ("task", "text", "y")), strict=True))
    for task, run in groupby(rows, key=lambda r: r[0]):
        yield task, ((text, y) for _, text, y in run)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, y, n): documents that hold a bucket; bucket -1 counts the documents."""
    counts, n, known = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64), _Words()
    for _, run in _by_task(batches):
        for text, y in run:
            if known.full():
                known.forget()
            rows = known.rows(list(set(words_of(text))))
            counts[y, np.unique(known.ids[rows])] += 1
            n[y] += 1
    for y in (0, 1):
        at = np.flatnonzero(counts[y])
        buckets, totals = np.append(at, -1), np.append(counts[y, at], n[y])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int64()), "y": pa.array(np.full(len(at) + 1, y), pa.int64()), "n": pa.array(totals, pa.int64())})


def _trained(trainer: Trainer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over each task's rows from the same start: its parameters that moved, with its number of rows."""
    for _, run in _by_task(batches):
        own, known, moved, n = copy.deepcopy(trainer), _Words(), [], 0
        docs, ys, size = [], [], 0

        def step():
            words, flat = np.unique(np.concatenate(docs), return_inverse=True)
            parts = np.split(flat, np.cumsum([len(d) for d in docs])[:-1])
            moved.append(own.step(known.ids[words], parts, np.array(ys)))
            docs.clear(), ys.clear()

        for text, y in run:
            docs.append(known.rows(words_of(text)))
            ys.append(y)
            n, size = n + 1, size + len(docs[-1])
            # a batch ends early on long texts, so that it stays bounded
            if len(docs) == BATCH or size > BATCH_WORDS:
                step()
                size = 0
                if known.full():
                    known.forget()
        if docs:
            step()
        numbers, rows = own.rows(np.unique(np.concatenate(moved)))
        columns = {f"v{k}": pa.array(rows[:, k].astype(np.float32), pa.float32()) for k in range(2 * DIM)}
        yield pa.RecordBatch.from_pydict({"number": pa.array(numbers, pa.int64()), "n": pa.array(np.full(len(rows), float(n))), **columns})


def _logit_counts(model: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, y, bin, n) of the logits, in bins of 1 / BINS."""
    scorer, found = Scorer(model), Counter()
    for _, run in _by_task(batches):
        for text, y in run:
            rows = scorer._rows(words_of(text))
            z = min(64.0, max(-64.0, logit(model, scorer.shares[rows])))
            found[language_of(scorer.vote[rows]), y, math.floor(z * BINS)] += 1
    keys = list(found)
    columns = {c: pa.array([k[i] for k in keys], pa.int64()) for i, c in enumerate(("language", "y", "bin"))}
    yield pa.RecordBatch.from_pydict({**columns, "n": pa.array(list(found.values()), pa.int64())})


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_chars: int | None = None, rounds: int = ROUNDS, rows_a_task: int = TASK_ROWS) -> Network:
    """Network from every labelled document outside the held-out fold, fitted where the documents are.

    Two thirds (by a hash of doc_id) train the network, one third calibrates the
    thresholds. Bucket counts are summed over all training rows. In each round
    every task passes over its ``rows_a_task`` rows from the same parameters, and
    what moved is averaged, weighted by rows; the driver sees parameters and
    counts only. Thresholds come from the counts of all calibration logits in bins of
    1 / BINS. With ``most_chars`` the fit reads ``WINDOWS`` windows of longer
    texts. Without both classes the scores stay below the threshold.
    """
    docs = docs.where("text IS NOT NULL")
    with scratch(docs.sparkSession):
        # ids alone are counted; then texts are dealt to the tasks by the shuffle that joins them, and by no other
        sizes = {r["y"]: r["count"] for r in labelled_texts(docs, labels, "toxic").groupBy("y").count().collect()}
        if len(sizes) < 2:
            k = FILTERS * len(WIDTHS)
            return Network(np.zeros((BUCKETS, DIM)), {w: np.zeros((w, DIM, FILTERS)) for w in WIDTHS}, np.zeros(k), np.zeros(k), 0.0, np.ones(5))
        tasks = -(-sum(sizes.values()) // rows_a_task)
        rows = labelled_texts(docs, labels, "toxic", tasks=tasks).withColumn("task", F.spark_partition_id())
        if most_chars is not None:
            rows = rows.withColumn("text", bounded("text", most_chars))
        aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(3)) == 2
        rows = rows.select(aside.alias("aside"), "task", "text", "y", F.xxhash64("doc_id", "text").alias("_key"))
        dealt = stage(rows.sortWithinPartitions("aside", "task", "_key").drop("_key"))
        own, aside = (dealt.where(F.col("aside") == side).select("task", "text", "y") for side in (False, True))
        found = own.mapInArrow(_bucket_counts, "bucket long, y long, n long").groupBy("bucket", "y").agg(F.sum("n").alias("n")).toPandas()
        counts, n = np.zeros((2, BUCKETS)), np.zeros(2)
        held = found[found["bucket"] >= 0]
        counts[held["y"], held["bucket"]] = held["n"]
        n[found.loc[found["bucket"] < 0, "y"]] = found.loc[found["bucket"] < 0, "n"]
        trainer = Trainer(_log_odds(counts, n), np.random.default_rng(11))
        names = [f"v{k}" for k in range(2 * DIM)]
        schema = "number long, n double, " + ", ".join(f"{c} float" for c in names)
        mean = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).cast("float").alias(c) for c in names]
        for _ in range(rounds):
            moved = own.mapInArrow(partial(_trained, trainer), schema).groupBy("number").agg(*mean).toPandas()
            if len(moved):
                trainer.take(moved["number"].to_numpy(), moved[names].to_numpy(dtype=float))
        model = trainer.network()
        z = aside.mapInArrow(partial(_logit_counts, model), "language long, y long, bin long, n long").groupBy("language", "y", "bin").agg(F.sum("n").alias("n")).toPandas()
    z = z.sort_values(["language", "y", "bin"])
    middle = (z["bin"].to_numpy(dtype=float) + 0.5) / BINS
    return _set_cuts(model, middle, z["y"].to_numpy(dtype=np.int64), z["n"].to_numpy(dtype=float), z["language"].to_numpy(dtype=np.int64), 25)


def toxicity_score(text: Column, model: Network) -> Column:
    """Score of each whole text, from 0 to 1; 0.5 is the threshold of its language."""
    small = replace(model, embedding=model.embedding.astype(np.float32))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(small)
        for texts in batches:
            z = np.array([scorer.logit(t) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return run(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from a score of 0.5 on) to every document.

    NULL and empty texts are scored as texts without words. Repeated rows score
    alike. An empty table stays empty. Columns of these names are replaced;
    labels, lang, source and doc_id are no inputs of a score.
    """
    model = fit_toxicity(docs, labels)
    scored = docs.withColumn("score", toxicity_score(F.col("text"), model))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
