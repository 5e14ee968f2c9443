"""Language identification by hierarchical discrimination.

The language family is decided first; within the family, one linear support
vector machine for each pair of its languages votes (one-versus-one).  Features
are hashed byte n-grams of the whole text, square-rooted and L2-normalised, so
a text of any length is one vector of ``DIMS`` values.

Training rows are a bounded sample (``per_language`` rows a language, chosen by
hash); prediction is one narrow pass, without a shuffle, over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.columns import extended, held_out, record_batch, require
from marginalia.llm.sampling import per_label
from marginalia.llm.textblocks import BLOCK, LOWER, text_array

DIMS = 1 << 13
UNDETERMINED = "und"

# Genealogical families of ISO 639-1 codes.  A code that is not
# listed forms a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no nb sv yi",
    "romance": "ca co es fr gl it oc pt rm ro sc wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "hellenic": "el",
    "indo-iranian": "as bn fa gu hi ku mr ne or pa ps sd si tg ur",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "sino-tibetan": "bo my zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "fj haw id jv mg mi ms sm su tl to",
    "tai": "lo th",
    "austroasiatic": "km vi",
    "bantu": "ny rw sn st sw tn xh zu",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_GRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
#: ASCII but letters is one symbol, so digits and punctuation tell nothing.
_SYMBOL = LOWER.copy()
_SYMBOL[[b for b in range(128) if not chr(b).isalpha()]] = 32


def ngram_vector(raw: np.ndarray) -> np.ndarray:
    """Hellinger vector of hashed byte 1- to 4-grams; a long text is read in pieces that overlap."""
    total = np.zeros(DIMS, dtype=np.float64)
    shift = np.uint32(32 - 13)
    for at in range(0, max(len(raw), 1), BLOCK):
        head = 3 if at else 0
        b = _SYMBOL[raw[max(0, at - head) : at + BLOCK]].astype(np.uint32)
        h = np.zeros(len(b), dtype=np.uint32)
        for n in range(1, 5):
            if len(b) < n:
                break
            h = (h[: len(b) - n + 1] if n > 1 else h) * np.uint32(31) + b[n - 1 :] * _GRAM[n - 1]
            skip = max(0, head - n + 1)  # those of the piece before
            total += np.bincount(((h[skip:] ^ (h[skip:] >> np.uint32(15))) * _GRAM[0]) >> shift, minlength=DIMS)
    v = np.sqrt(total)
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).astype(np.float32)


def has_letter(raw: np.ndarray) -> bool:
    if ((raw | 32) - 97 < 26).any():
        return True
    return bool(len(raw)) and any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))


def linear_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 25, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-loss linear support vector machine over ``rows`` of ``x``: weights and bias.

    No part of ``x`` is copied: it is the driver's largest array.
    """
    w, bias, alpha = np.zeros(x.shape[1], dtype=np.float64), 0.0, np.zeros(len(rows))
    diagonal = np.einsum("ij,ij->i", x, x)[rows] + 1.0 + 0.5 / cost
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            own = x[rows[i]]
            gradient = y[i] * (float(own @ w) + bias) - 1 + 0.5 / cost * alpha[i]
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * own
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _slope(margins: np.ndarray, y: np.ndarray) -> float:
    """How steep a logistic curve over the margins fits the (smoothed) labels best."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    grid = np.geomspace(0.5, 20, 40)
    p = 1 / (1 + np.exp(-np.clip(grid[:, None] * margins[None], -40, 40)))
    loss = -(t * np.log(p + 1e-12) + (1 - t) * np.log(1 - p + 1e-12)).mean(1)
    return float(grid[loss.argmin()])


@dataclass
class Duels:
    """One-versus-one machines among a list of classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    slope: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, classes: list[str]) -> Duels:
        out = cls(classes)
        w, c, s = [], [], []
        for a in range(len(classes)):
            for b in range(a + 1, len(classes)):
                own = np.flatnonzero((label == classes[a]) | (label == classes[b]))
                y = np.where(label[own] == classes[a], 1.0, -1.0)
                weights, bias = linear_svm(x, own, y)
                weights = weights.astype(np.float32)
                out.pairs.append((a, b))
                w.append(weights)
                c.append(bias)
                s.append(_slope((x @ weights)[own] + bias, y))
        if w:
            out.weights, out.bias, out.slope = np.array(w).T.copy(), np.array(c), np.array(s)
        return out

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        """The class that wins most duels (ties: by probability) and its mean probability of winning."""
        if not self.pairs:
            return self.classes[0], 1.0
        p = 1 / (1 + np.exp(-np.clip(self.slope * (v @ self.weights + self.bias), -40, 40)))
        won, sure = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (a, b), q in zip(self.pairs, p, strict=True):
            won[a] += q >= 0.5
            won[b] += q < 0.5
            sure[a] += q
            sure[b] += 1 - q
        best = max(range(len(self.classes)), key=lambda k: (won[k], sure[k]))
        return self.classes[best], float(sure[best] / (len(self.classes) - 1))


@dataclass
class Model:
    families: Duels
    within: dict[str, Duels]

    def predict(self, raw: np.ndarray) -> tuple[str, float]:
        v = ngram_vector(raw)
        family, p = self.families.decide(v)
        lang, q = self.within[family].decide(v)
        return lang, p * q


def fit(docs: DataFrame, train, id_column: str = "doc_id", per_language: int = 400, seed: str = "langid") -> Model | None:
    """Learn from rows where ``train`` holds, text is not null and lang is not null.

    At most about ``per_language`` rows a language are used, chosen by a hash of
    the id; their feature vectors alone come to the driver.  None without rows.
    """
    require(docs, id_column, "text", "lang")
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(id_column, "text", "lang")
    sample = per_label(rows, "lang", id_column, per_language, seed).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("vector", pa.binary())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_array(batch.column(1))
            made = [ngram_vector(raw[a:b]).astype(np.float16).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield record_batch(schema, [batch.column(0).cast(pa.string()), made])

    got = sorted((r["lang"], bytes(r["vector"])) for r in sample.mapInArrow(vectors, "lang string, vector binary").collect())
    if not got:
        return None
    label = np.array([g[0] for g in got], dtype=object)
    x = np.empty((len(got), DIMS), dtype=np.float32)
    for k, (_, vector) in enumerate(got):
        x[k] = np.frombuffer(vector, dtype=np.float16)
    del got
    family = np.array([FAMILY_OF.get(code, code) for code in label], dtype=object)
    return Model(Duels.fit(x, family, sorted(set(family))), {f: Duels.fit(x, label, sorted(set(label[family == f]))) for f in set(family)})


def identify(docs: DataFrame, model: Model | None, id_column: str = "doc_id") -> DataFrame:
    """Add ``lang_pred`` string and ``score`` double (0 to 1) to every row of ``docs``.

    ``und`` with score 0 where the text is null or empty, has no letter, or
    nothing was learned.  Equal texts get equal results; repeated rows stay;
    columns that are in the input already under these names are replaced.
    """
    require(docs, "text")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    carried = docs.select(*kept)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_array(batch.column("text"))
            lang, score = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = raw[a:b]
                got = model.predict(own) if model is not None and has_letter(own) else (UNDETERMINED, 0.0)
                lang.append(got[0])
                score.append(got[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return carried.mapInArrow(predict, extended(carried, "lang_pred string, score double"))


def op1_langid(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; crc32(doc_id) mod 3 = 1 is held out of training."""
    require(docs, "doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs, ~out, per_language=per_language)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
