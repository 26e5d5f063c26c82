"""Operator 3: language of whole texts by string kernels.

A text becomes the set of its blended-spectrum n-grams (1 to 3 letters, lower case, runs of other characters as one
boundary), hashed to 2^18 places. The kernel of two texts is the number of n-grams present in both over the geometric
mean of their set sizes. Landmark texts give a Nyström map into a few hundred dimensions, in which one kernel ridge
regression a language is fitted against all others. Because everything after the presence vector is linear, the map and
the regressions multiply into one matrix, and a block of texts is scored by one product of the presence matrix with it.

The classifier is fitted on a bounded sample of labelled rows: for each language the `per_lang` first in a fixed
scattering of doc_id among rows that are not held out, those of at most `longest` characters before longer ones, the
shortest of these first; `landmarks` of them serve as landmarks, and the `vocabulary` n-grams that most landmarks hold
are kept (a departure from the plain kernel that bounds the matrix). The first rows are found with one window, limited
in every task and once more in parts of a language before the language as a whole. Scoring covers every whole text.
Training sets, not texts, reach the driver, at most per_lang x languages of them, however often a doc_id repeats.

Defined results: null text and text without a letter (Unicode category L, in all planes) give `und` with score 0; so does
every text if no labelled row exists; rows without a doc_id are told but not learned from; the score is the logistic of
the lead over the second language, 0.5 at a tie, which goes to the language that comes first by code point; repeated
rows and equal texts get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, by_blocks, only
from .mixing import order_key

PLACES = 1 << 18
#: Code points from here on hold no letters (planes 4 to 16 are unassigned, special or private).
END = 0x40000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> 0 for what is no letter, else the code point of the lower-case letter."""
    out = np.zeros(END + 1, np.uint32)
    for cp in range(END):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def coded(text: str) -> np.ndarray:
    """The letters of a text, 0 for everything else."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return letters()[np.minimum(points, END)]


def presence(codes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The sorted places of a text's n-grams; `flags` is a cleared work array."""
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    a, b, c = (codes * np.uint32(k) for k in (2654435761, 2246822519, 3266489917))
    two = a[:-1] ^ (b[1:] >> np.uint32(3))
    three = two[:-1] * np.uint32(668265263) + c[2:]
    for grams, salt in ((a, 1), (two, 2), (three, 3)):
        flags[(grams * np.uint32(374761393) + np.uint32(salt * 40503)) >> np.uint32(14)] = True
    places = np.flatnonzero(flags)
    flags[places] = False
    return places


class Model:
    def __init__(self, langs: list[str], vocabulary: np.ndarray, weights: np.ndarray):
        self.langs, self.vocabulary, self.weights = langs, vocabulary, weights

    def block(self, sets: list[np.ndarray]) -> np.ndarray:
        """Scores of a block of texts, one column a language."""
        return matrix(sets, self.vocabulary) @ self.weights

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        only("language", letters.cache_clear)
        flags = np.zeros(PLACES, bool)
        sets = {i: presence(c, flags) for i, t in enumerate(texts) if t and (c := coded(t)).any()} if self.langs else {}
        good, out = list(sets), [("und", 0.0)] * len(texts)
        if good:
            scores = self.block(list(sets.values())).astype(np.float64)
            best = scores.argmax(axis=1)
            top = scores[np.arange(len(good)), best]
            scores[np.arange(len(good)), best] = -np.inf
            second = np.maximum(scores.max(axis=1), -1.0) if len(self.langs) > 1 else np.full(len(good), -1.0)
            lead = 1 / (1 + np.exp(-4 * np.clip(top - second, 0, 100)))
            for i, b, s in zip(good, best, lead, strict=True):
                out[i] = (self.langs[b], round(float(s), 6))
        return out


def matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Presence of the vocabulary in each set, over the root of the whole set's size."""
    out, flags = np.empty((len(sets), len(vocabulary)), np.float32), np.zeros(PLACES, bool)
    for i, s in enumerate(sets):
        flags[s] = True
        np.multiply(flags[vocabulary], np.float32(1 / np.sqrt(max(len(s), 1))), out=out[i])
        flags[s] = False
    return out


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = 40, vocabulary: int = 12_288, ridge: float = 0.03) -> Model:
    """One-versus-rest kernel ridge regression on the Nyström features of (language, set) samples."""
    langs = sorted({x for x, _ in samples}, key=lambda x: x.encode("utf-8", "surrogatepass"))
    if not langs:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    seen = dict.fromkeys(langs, 0)
    is_mark = []
    for x, _ in samples:
        is_mark.append(seen[x] < landmarks)
        seen[x] += 1
    held = np.zeros(PLACES, np.int32)
    for (_, s), m in zip(samples, is_mark, strict=True):
        held[s] += m
    words = np.sort(np.lexsort((np.arange(PLACES), -held))[: min(vocabulary, int((held > 0).sum()))])
    x = matrix([s for _, s in samples], words)
    marks = x[np.array(is_mark)]
    k = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(k)
    keep = value > value[-1] * 1e-7
    root = vector[:, keep] / np.sqrt(value[keep])  # K^(-1/2) up to a rotation
    phi = (x @ marks.T).astype(np.float64) @ root
    y = np.array([[1.0 if lang == own else -1.0 for lang in langs] for own, _ in samples])
    counts = np.array([seen[own] for own, _ in samples], float)
    w = (1 / counts)[:, None] * (len(samples) / len(langs))
    beta = np.linalg.solve(phi.T @ (phi * w) + ridge * np.eye(phi.shape[1]), phi.T @ (y * w))
    return Model(langs, words, (marks.T.astype(np.float64) @ (root @ beta)).astype(np.float32))


def held_out(name: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, per_lang: int = 300, longest: int = 20_000, **how) -> Model:
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    over = F.greatest(F.length("text") - longest, F.lit(0))
    ids = rows.select("doc_id", "lang", over.alias("over"), order_key().alias("o"), F.xxhash64("text").alias("h")).withColumn("part", F.pmod("h", F.lit(16)))
    for by in (("lang", "part"), ("lang",)):
        first = Window.partitionBy(*by).orderBy("over", "o", "doc_id", "h")
        ids = ids.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_lang).drop("_n")
    chosen = attach(rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("h")), ids.select("doc_id", "lang", "h"), ["doc_id", "lang", "h"], how="left_semi")
    chosen = chosen.dropDuplicates(["doc_id", "lang", "h"])

    def block(found):
        flags = np.zeros(PLACES, bool)
        return [(key, lang, presence(c, flags).astype(np.int32).tolist()) for key, lang, text in found if (c := coded(text)).any()]

    sets = by_blocks(chosen, ["doc_id", "lang", "text"], "doc_id bigint, lang string, places array<int>", block).collect()
    sets.sort(key=lambda r: (r.doc_id * 2654435761 % 2147483647, r.doc_id, r.places))
    return fit([(r.lang, np.array(r.places, np.int64)) for r in sets], **how)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def block(rows):
        return [(key, held, lang, score) for (key, held, _), (lang, score) in zip(rows, model.predict([r[2] for r in rows]), strict=True)]

    rows = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias(text_col))
    return by_blocks(rows, [id_col, "held_out", text_col], f"{id_col} {kind}, held_out boolean, lang_pred string, score double", block)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.51) -> DataFrame:
    """The rows whose language is told with a score of at least `least`, all columns as they were."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        at = names.index("text")
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = model.predict([t.as_py() for t in part.column(at)])
                yield pa.RecordBatch.from_arrays(part.filter(pa.array([lang != "und" and s >= least for lang, s in found])).columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
