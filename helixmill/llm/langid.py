"""Language identification by hierarchical discrimination.

Character n-grams of the whole text (hashed bytes of one to four, damped and
scaled to unit length) first choose the language family; inside a family the
languages meet one against one in linear support vector machines, and the
votes, then the margins, decide.  Both levels are linear machines trained here
by averaged sub-gradient descent on a bounded sample.

At most ``SAMPLE`` labelled documents, the same number of each language and
those with the least hashes of key and text, bound what training gathers.  Prediction reads each whole
text once, in Arrow batches, with the small model broadcast.

Edge cases: a null text or one without letters gives ``und`` with score 0;
with no labelled document every prediction is ``und``; one learned language is
always predicted, with score 1; null labels are not learned from; labels that
are not in ``FAMILIES`` form a family each; repeated rows are returned each;
other columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents that training may use, in whole and per language.
SAMPLE = 1600
SAMPLE_PER_LANGUAGE = 400
#: Log of the number of n-gram features.
BITS = 13
EPOCHS = 12
#: Families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi ur bn pa mr gu ne si",
    "iranian": "fa ps ku tg",
    "uralic": "fi et hu",
    "turkic": "tr az uz kk ky tk",
    "semitic": "ar he am mt",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
    "hellenic": "el",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # all that is no letter


def vector(raw) -> np.ndarray | None:
    """Unit vector of a text's hashed byte n-grams; None without letters."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    blank = data == 32
    if blank.all():
        return None
    data = data[~(blank & np.r_[False, blank[:-1]])].astype(np.uint32)  # runs of other characters count once
    data = np.concatenate([[np.uint32(32)], data, [np.uint32(32)]])
    total = np.zeros(1 << BITS)
    h = np.zeros(len(data), np.uint32)
    for n in range(4):
        h = h[: len(data) - n] * _ODD[1] + data[n:] + np.uint32(n)
        x = h * _ODD[0]
        total += np.bincount(x >> np.uint32(32 - BITS), minlength=1 << BITS)
    total = np.sqrt(total)
    return total / np.linalg.norm(total)


def has_letters(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _svm(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Averaged Pegasos; the last weight is the bias.  Rows of both classes weigh the same in sum."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    lam, w, mean, t = 1e-4, np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    size = 32
    steps = EPOCHS * -(-len(x) // size)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), -(-len(x) // size)):
            t += 1
            bad = y[part] * (x[part] @ w) < 1
            g = lam * w - ((y[part] * weight[part])[bad] @ x[part][bad]) / len(part)
            w = w - g / (lam * (t + 200))
            if t > steps // 2:
                mean += w
    return mean / max(1, steps - steps // 2)


class Model:
    """Families, then pairs of languages inside each."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        self.families: dict[str, list[str]] = {}
        for lang in self.languages:
            self.families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
        y = np.array(labels, dtype=object)
        of = np.array([_FAMILY.get(v, v) for v in labels], dtype=object)
        self.names = sorted(self.families)
        self.top = np.array([_svm(x, np.where(of == f, 1.0, -1.0), i) for i, f in enumerate(self.names)], np.float64) if len(self.names) > 1 else None
        self.pairs: dict[str, list[tuple[int, int]]] = {}
        self.machines: dict[str, np.ndarray] = {}
        for f, langs in self.families.items():
            self.pairs[f] = list(itertools.combinations(range(len(langs)), 2))
            out = []
            for a, b in self.pairs[f]:
                rows = (y == langs[a]) | (y == langs[b])
                out.append(_svm(x[rows], np.where(y[rows] == langs[a], 1.0, -1.0), 7 * a + b))
            self.machines[f] = np.array(out, np.float64)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        v = np.append(v, 1.0)
        sure = lambda m: 1 / (1 + np.exp(-2 * min(max(m, -50), 50)))
        family, score = self.names[0], 1.0
        if self.top is not None:
            m = self.top @ v
            o = np.argsort(-m, kind="stable")
            family, score = self.names[o[0]], sure(m[o[0]] - m[o[1]])
        langs = self.families[family]
        if len(langs) == 1:
            return langs[0], float(score)
        votes, margins, least = np.zeros(len(langs)), np.zeros(len(langs)), np.full(len(langs), np.inf)
        for (a, b), m in zip(self.pairs[family], self.machines[family] @ v):
            votes[a if m >= 0 else b] += 1
            margins[[a, b]] += (m, -m)
            least[[a, b]] = np.minimum(least[[a, b]], (m, -m))
        best = max(range(len(langs)), key=lambda i: (votes[i], margins[i], -i))
        return langs[best], float(score * sure(least[best]))


def fit(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Trains on ``key, text, lang``; None without labelled texts that have letters."""
    labelled = rows.where("lang is not null and text is not null").withColumn("h", F.xxhash64("key", "text"))
    counts = labelled.select("lang").distinct().limit(SAMPLE + 1).count()
    if not counts:
        return None
    per_language = min(per_language, max(1, SAMPLE // counts))
    # numbers only: the least hashes of each language, cut in each task before they are shuffled
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("o", "h"))
    least = labelled.select("lang", "h", F.pmod("h", F.lit(1 << 20)).alias("o")).withColumn("nth", nth).where(F.col("nth") <= per_language)
    # languages beyond SAMPLE (no corpus has them) lose their draw by hash, so that the bound always holds
    picked = least.select("lang", "h").distinct().orderBy("h").limit(SAMPLE) if counts > SAMPLE else least.select("lang", "h").distinct()
    drawn = labelled.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], []]
            for lang, text, h in zip(*b.columns):
                v = vector(text.as_buffer()) if has_letters(text.as_py()) else None
                if v is not None:
                    out[0].append(lang.as_py())
                    out[1].append(h.as_py())
                    out[2].append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["lang", "h", "v"])

    got = sorted(drawn.select("lang", "text", "h").mapInArrow(vectors, "lang string, h long, v binary").collect(), key=lambda r: (r["lang"], r["h"] % (1 << 20), r["h"]))  # SAMPLE rows at most
    labels, x = [r["lang"] for r in got], [np.frombuffer(r["v"], np.float32) for r in got]
    return Model(np.array(x), labels) if labels else None


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", extra: Column | None = None) -> DataFrame:
    """``key``, the boolean ``extra`` as ``held_out``, ``lang_pred`` and ``score`` per document."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score = [], []
            for t in b.column(2):
                v = vector(t.as_buffer()) if m and has_letters(t.as_py()) else None
                p = m.predict(v) if v is not None else ("und", 0.0)
                lang.append(p[0])
                score.append(p[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    return docs.select(F.col(f"`{key}`"), (extra if extra is not None else F.lit(False)).alias("held_out"), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Whether the crc32 of the key as text leaves 0 when divided by 5; false for a null key."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learns from the documents that are not held out, then predicts all."""
    train = docs.where(~held_out(key)).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    return predict(docs, fit(train, per_language), key, text, held_out(key))
