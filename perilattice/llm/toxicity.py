"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alikes of Latin letters, and digits or signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ß": "b",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
#: Words to start from where no labelled row is toxic, and phrases in which a listed word is harmless beside those that are learnt.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting")
EXCEPTIONS = ("pond scum", "trash can", "trash bin", "clown fish", "sore loser", "stupid question")
PREFIXES = (4, 5, 6)


class _Fold(dict):
    """Folding table, filled by rule as characters are met: lower case, no accents, look-alikes and substitutes as letters, the rest a space."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            c = SUBSTITUTES.get(LOOKALIKES.get(c, c), LOOKALIKES.get(c, c))
            if not (unicodedata.combining(c) or unicodedata.category(c) == "Cf"):
                out += c if c.isalnum() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words with one space between them and at both ends, whatever separates them in the text."""
    words = " ".join((text or "").translate(_FOLD).split())
    return f" {words} " if words else " "


@dataclass
class Model:
    """weights: by folded entry, ' word ' or ' prefix'; coef: of 1, log(1+sum), log(1+100 sum/words) and the largest weight."""

    weights: dict[str, float]
    coef: list[float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            entry = f" {' '.join(fold(phrase).split())} "
            a.add_word(entry, (len(entry), None))
        a.make_automaton()
        return a


def features(text: str | None, automaton) -> tuple[float, float, float, float]:
    """(sum of weights, hits, largest weight, words). A word counts once, by its heaviest entry; words in an exception phrase count nothing."""
    s = fold(text)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (n, w) in automaton.iter(s):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            else:
                best[at] = max(w, best.get(at, w))
    for a, b in spared:
        best = {k: w for k, w in best.items() if not a <= k < b}
    return sum(best.values()), float(len(best)), max(best.values(), default=0.0), float(s.count(" ") - 1)


def phrases(text: str | None, automaton) -> set[str]:
    """Pairs of neighbouring words of which the automaton knows one."""
    s, out = fold(text), set()
    for end, (n, _) in automaton.iter(s):
        at = end - n + 1  # the space before the word
        close = s.find(" ", at + 1)
        if at > 0:
            out.add(s[s.rfind(" ", 0, at) + 1 : close])
        if 0 < close < len(s) - 1:
            out.add(s[at + 1 : s.find(" ", close + 1)])
    return out


def design(f: np.ndarray) -> np.ndarray:
    total, words = f[:, 0], np.maximum(f[:, 3], 1.0)
    return np.column_stack([np.ones(len(f)), np.log1p(total), np.log1p(100 * total / words), f[:, 2]])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; classes weigh as they occur."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * w * np.array([0, *[1] * (x.shape[1] - 1)])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * ridge
        step = np.linalg.solve(h, x.T @ (y - p) - pull)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, max_entries: int = 50_000, least_gain: float = 20.0, least_clean: int = 3) -> Model:
    """Learn the lexicon and the coefficients from at most max_rows labelled documents, chosen by a hash of the id.

    The rows of labels decide who learns: pass training rows only. Entries are words and word prefixes whose document
    frequency among toxic documents is larger beyond chance (signed G-squared of at least least_gain); at most max_entries,
    the best. Pairs of words of which the lexicon knows one become exception phrases if at least least_clean clean documents
    and no toxic one has them. Labels that are null are left out; of several labels of an id the largest holds. Without toxic or clean rows
    a small seed list and set coefficients are used.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # at most max_rows pairs of numbers are broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, list[int]] = {}
            sizes = [0, 0]
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sizes[y] += 1
                words = set(fold(text).split())
                for e in {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}:
                    count.setdefault(e, [0, 0])[y] += 1
            count[""] = sizes
            yield pa.RecordBatch.from_pydict({"entry": list(count), "clean": [v[0] for v in count.values()], "toxic": [v[1] for v in count.values()]}, schema=pa.schema([("entry", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    counts = sample.mapInArrow(parts, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    top = counts.where("toxic >= 3 or entry = ''").where("entry = '' or toxic > clean").orderBy(F.when(F.col("entry") == "", 0).otherwise(1), F.col("toxic").desc(), "entry").limit(4 * max_entries).collect()
    sizes = next(((r.clean, r.toxic) for r in top if not r.entry), (0, 0))
    if not all(sizes):
        return Model({f" {w} ": 4.0 for w in (" ".join(fold(x).split()) for x in SEED)}, [-4.0, 2.0, 1.0, 0.5])
    weights = {}
    for r in top:
        if not r.entry:
            continue
        t, c = r.toxic / sizes[1], r.clean / sizes[0]
        mean = (r.toxic + r.clean) / sum(sizes)
        gain = 2 * (r.toxic * np.log(t / mean) + (r.clean * np.log(c / mean) if r.clean else 0.0))
        w = float(np.log((r.toxic + 0.5) / (sizes[1] + 1)) - np.log((r.clean + 0.5) / (sizes[0] + 1)))
        if t > c and gain >= least_gain and w >= 1.5:
            weights[r.entry] = (gain, w)
    weights = {k: w for k, (_, w) in sorted(weights.items(), key=lambda x: (-x[1][0], x[0]))[:max_entries]}
    model = Model(weights, [], ())

    def harmless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for batch in batches:
            count: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for phrase in phrases(text, a) if len(a) else ():
                    count.setdefault(phrase, [0, 0])[y] += 1
            yield pa.RecordBatch.from_pydict({"phrase": list(count), "clean": [v[0] for v in count.values()], "toxic": [v[1] for v in count.values()]}, schema=pa.schema([("phrase", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    seen = sample.mapInArrow(harmless, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    spared = seen.where((F.col("toxic") == 0) & (F.col("clean") >= least_clean)).orderBy(F.desc("clean"), "phrase").limit(max_entries).collect()
    model.exceptions = (*EXCEPTIONS, *(r.phrase for r in spared))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for batch in batches:
            rows = [(*features(t, a), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({k: [float(r[i]) for r in rows] for i, k in enumerate(("total", "hits", "top", "words", "y"))})

    got = np.array(sample.mapInArrow(measure, "total double, hits double, top double, words double, y double").collect(), dtype=float)  # at most max_rows rows
    model.coef = logistic(design(got), got[:, 4]).tolist()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' columns with score (0 to 1), predicted (1 if score >= 0.5, else 0) and hits.

    The whole text counts. A null or empty text has no hits and the score of that. Input columns of these names are replaced.
    """
    new = ("score", "predicted", "hits")

    def run(texts: Iterator) -> Iterator:
        import pandas as pd

        a, coef = model.automaton(), np.array(model.coef)
        for series in texts:
            f = np.array([features(t, a) for t in series], dtype=float).reshape(len(series), 4)
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(design(f) @ coef, -40, 40))), "hits": f[:, 1].astype("int64")})

    from pyspark.sql.functions import pandas_udf

    run.__annotations__ = {}
    udf = pandas_udf(run, "score double, hits long", functionType=F.PandasUDFType.SCALAR_ITER)
    kept = [c for c in docs.columns if c not in new]
    out = docs.withColumn("__x3", udf(F.col(text_col).cast("string")))
    return out.select(*kept, F.col("__x3.score").alias("score"), (F.col("__x3.score") >= 0.5).cast("int").alias("predicted"), F.col("__x3.hits").alias("hits"))
