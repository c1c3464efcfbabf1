"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

A text is the square roots of its letter n-grams' relative frequencies, hashed into FEATURES bins, so its vector has
length one whatever the text's length.  One linear machine tells the families apart (one against the rest);
within the winner every pair of languages has a machine of its own and the language with most wins is taken.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table

FEATURES = 8192
#: Training reads so many labelled documents of a language at most, those of least hash, and whole texts.
SAMPLE_A_LANGUAGE = 500
#: Most languages that are told apart; labels past it are noise, not languages.
MOST_LANGUAGES = 1000
#: Languages with fewer than this aren't learned.
LEAST_A_LANGUAGE = 2
#: Families of languages by ISO 639-1 code.  Others form a family of their own each.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sk": "slavic",
}
UND = "und"
#: A text is foreign to a language where its n-grams are by so many nats on average less likely there than those of the language's
#: usual text, which is learned from texts that the frequencies haven't seen; under LIKENESS_BYTES of letters by more, as
#: the mean of few n-grams varies with the root of their number.
FAR, LIKENESS_BYTES = 1.6, 60
#: Part of a language's likelihood that its n-grams share by frequency; each n-gram has FLOOR of the even one besides.
SEEN, FLOOR = 0.9, 0.01


def letters(text: str | None) -> bytes:
    """Lower-case letters in UTF-8 with one blank before, between and after words; empty without letters."""
    import regex

    global _SPLIT
    if _SPLIT is None:
        _SPLIT = regex.compile(r"[^\p{L}\p{M}]+").sub
    out = _SPLIT(" ", (text or "").lower()).strip()
    return f" {out} ".encode() if any(map(str.isalpha, out[:64])) or any(map(str.isalpha, out)) else b""


_SPLIT = None


def histogram(raw: bytes) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of bytes."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.bincount(x, minlength=FEATURES)
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    for gram, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
        out += np.bincount(gram * np.uint32(salt) >> shift, minlength=FEATURES)
    return out


def vector(raw: bytes) -> np.ndarray:
    h = np.sqrt(histogram(raw).astype(np.float32))
    return h / np.sqrt((h * h).sum())


@dataclass
class Rows:
    """Sparse rows: row i has `values` at `bins`, both from starts[i] to starts[i + 1]; a bias of one is understood."""

    starts: np.ndarray
    bins: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, bins: list[np.ndarray], values: list[np.ndarray]) -> Rows:
        none = [np.zeros(0, np.int32)]
        return cls(np.concatenate(([0], np.cumsum([len(b) for b in bins]))).astype(np.int64), np.concatenate(bins or none), np.concatenate(values or none).astype(np.float32))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def logs(self, rows: np.ndarray) -> np.ndarray:
        """Logarithms of the likelihoods of n-grams: their mean frequencies in some rows, which are roots of frequencies, above a floor."""
        out = np.zeros(FEATURES)
        for i in rows:
            out[self.bins[self.starts[i] : self.starts[i + 1]]] += self.values[self.starts[i] : self.starts[i + 1]].astype(float) ** 2
        return np.log(SEEN * out / max(1, len(rows)) + FLOOR / FEATURES)

    def usual(self, rows: np.ndarray) -> float:
        """The median of rows' mean logarithms, each half of them judged by the other's frequencies."""
        seen = []
        for half, other in ((rows[::2], rows[1::2]), (rows[1::2], rows[::2])):
            logs = self.logs(other)
            seen += [float(self.values[a:b].astype(float) ** 2 @ logs[self.bins[a:b]]) for a, b in zip(self.starts[half], self.starts[half + 1], strict=True)]
        return float(np.median(seen))


def linear_svm(x: Rows, rows: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Weights, the bias last, of the squared-hinge linear machine for labels -1 and 1 of some rows, by dual coordinate descent."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(FEATURES + 1), np.zeros(len(rows))
    # The rarer class weighs more, so that unequal samples don't shift the border.
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    each = [(x.bins[x.starts[i] : x.starts[i + 1]], x.values[x.starts[i] : x.starts[i + 1]].astype(np.float64)) for i in rows]
    norm = np.array([v @ v + 1 for _, v in each]) + 1 / (2 * cost)
    for _ in range(rounds):
        change = 0.0
        for i in rng.permutation(len(rows)):
            bins, values = each[i]
            g = y[i] * (w[bins] @ values + w[-1]) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[bins] += step * values
                w[-1] += step
                change = max(change, abs(new - alpha[i]))
                alpha[i] = new
        if change < 1e-3:
            break
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None  # families x (FEATURES + 1)
    pairs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)
    logs: np.ndarray | None = None  # languages x FEATURES: logarithms of the n-grams' likelihoods
    usual: np.ndarray | None = None  # of each language: the mean logarithm of its usual text

    def unlikeness(self, x: np.ndarray) -> np.ndarray:
        """By how much each row's n-grams are less likely than a usual text's, in the language where that is least; rows are roots of frequencies."""
        return (self.usual - (x * x) @ self.logs.T).min(1)

    def foreign(self, x: np.ndarray, size: np.ndarray, far: float = FAR) -> np.ndarray:
        """Whether each row, of so many bytes of letters, is in none of the learned languages."""
        return self.unlikeness(x) > far * np.maximum(1, np.sqrt(LIKENESS_BYTES / size))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of each row: the score is the logistic of the least margin on the way."""
        if not self.families:
            return [(UND, 0.0)] * len(x)
        scores = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
        won = scores.argmax(1)
        ordered = np.sort(scores, 1)
        margin = ordered[:, -1] - (ordered[:, -2] if scores.shape[1] > 1 else 0)
        out: list[tuple[str, float]] = [("", 0.0)] * len(x)
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(won == f)
            if not len(rows):
                continue
            names = self.members[family]
            if len(names) == 1:
                lang, least = np.zeros(len(rows), int), margin[rows]
            else:
                duel = x[rows] @ self.pair_weights[family][:, :-1].T + self.pair_weights[family][:, -1]
                votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
                for j, (a, b) in enumerate(self.pairs[family]):
                    votes[:, a] += duel[:, j] > 0
                    votes[:, b] += duel[:, j] <= 0
                    sums[:, a] += duel[:, j]
                    sums[:, b] -= duel[:, j]
                lang = np.array([max(range(len(names)), key=lambda i: (v[i], s[i], -i)) for v, s in zip(votes, sums, strict=True)])
                own = np.full(len(rows), np.inf)
                for j, (a, b) in enumerate(self.pairs[family]):
                    own = np.where(lang == a, np.minimum(own, duel[:, j]), np.where(lang == b, np.minimum(own, -duel[:, j]), own))
                least = np.minimum(own, margin[rows])
            for i, k, m in zip(rows, lang, least, strict=True):
                out[i] = (names[k], float(1 / (1 + np.exp(-np.clip(m, -30, 30) * 3))))
        return out


def fit(x: Rows, langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
    known = sorted(v for v, n in Counter(langs).items() if n >= LEAST_A_LANGUAGE)
    model = Model()
    if not known:
        return model
    lang = np.array(langs)
    for v in known:
        model.members.setdefault(families.get(v, v), []).append(v)
    model.families = sorted(model.members)
    model.logs = np.stack([x.logs(np.flatnonzero(lang == v)) for v in known]).astype(np.float32)
    model.usual = np.array([x.usual(np.flatnonzero(lang == v)) for v in known], np.float32)
    family = np.array([families.get(v, v) for v in langs])
    keep = np.flatnonzero(np.isin(lang, known))
    if len(model.families) == 1:
        model.family_weights = np.zeros((1, FEATURES + 1))
        model.family_weights[0, -1] = 1
    else:
        model.family_weights = np.stack([linear_svm(x, keep, np.where(family[keep] == f, 1, -1)) for f in model.families])
    for f, names in model.members.items():
        model.pairs[f] = list(combinations(range(len(names)), 2))
        weights = []
        for a, b in model.pairs[f]:
            rows = np.flatnonzero(np.isin(lang, [names[a], names[b]]))
            weights.append(linear_svm(x, rows, np.where(lang[rows] == names[a], 1, -1)))
        model.pair_weights[f] = np.stack(weights).astype(np.float32) if weights else np.zeros((0, FEATURES + 1), np.float32)
    model.family_weights = model.family_weights.astype(np.float32)
    return model


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; null ids have the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, str] = FAMILIES) -> Model:
    """A model from labelled rows outside of the held-out fold: SAMPLE_A_LANGUAGE of each language at most, of least hash.

    The hash is of the text and each text of a language counts once, so copies neither crowd the sample out nor shrink it:
    what is counted, cut and ranked are the distinct (lang, hash), met in partial sums.  A language's share of its distinct
    hashes that goes on to the exact cut follows from their count, so no task gets more than some thousands of rows;
    the chosen hashes then fetch one text each.  Documents without letters teach nothing.
    """
    rows = docs.where((fold(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    distinct = rows.select("lang", "h").distinct()
    counts = distinct.groupBy("lang").agg(F.count("*").alias("all")).orderBy(F.desc("all"), "lang").limit(MOST_LANGUAGES)
    # Hashes lie evenly, so a cut that leaves a few times the bound of each language holds its least ones.
    part = F.least(F.lit(1.0), (4.0 * SAMPLE_A_LANGUAGE + 200) / F.col("all"))
    near = distinct.join(F.broadcast(counts), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= part).select("lang", "h")
    order = Window.partitionBy("lang").orderBy("h")
    chosen = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_A_LANGUAGE).select("lang", "h")
    # A few hundred hashes a language; rows of one hash have one text.
    picked = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text", "h")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, bins, values = [], [], []
            for x in batch.column(1):
                raw = letters(x.as_py())
                keep.append(bool(raw))
                if raw:
                    v = vector(raw)
                    at = np.flatnonzero(v)
                    bins.append(at.astype(np.int32).tobytes())
                    values.append(v[at].astype(np.float32).tobytes())
            kept = batch.filter(pa.array(keep))
            return pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), pa.array(bins, pa.binary()), pa.array(values, pa.binary())], ["lang", "h", "bins", "v"])

        return each

    got = sorted(map_arrow(picked, make, "lang string, h long, bins binary, v binary").collect(), key=lambda r: (r.lang, r.h))
    x = Rows.of([np.frombuffer(r.bins, np.int32) for r in got], [np.frombuffer(r.v, np.float32) for r in got])
    return fit(x, [r.lang for r in got], families)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every whole text.

    Null texts and texts without letters are `und` with score 0; so is everything where nothing could be learned.  Repeated
    rows stay.  No shuffle: the model, some 32 KB a machine, goes to the tasks.
    """
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        block = 512

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = [UND] * batch.num_rows, [0.0] * batch.num_rows
            for at in range(0, batch.num_rows, block):
                where, rows = [], []
                for i, x in enumerate(batch.column(1).slice(at, block), at):
                    if raw := letters(x.as_py()):
                        where.append(i)
                        rows.append(vector(raw))
                if rows:
                    for i, (v, s) in zip(where, m.predict(np.stack(rows)), strict=True):
                        lang[i], score[i] = v, s
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

        return each

    return map_arrow(docs.select(id_col, text_col, (fold(id_col) == 1).alias("held_out")), make, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
