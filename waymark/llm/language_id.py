"""Language identification by hierarchical discrimination: family first, then one-versus-one linear SVMs within it.

Texts become hashed counts of byte n-grams (2 to 4 bytes of the lower-cased text, all but letters as spaces), square-rooted
and scaled to length 1. Linear support vector machines (L2-regularised, squared hinge, dual coordinate descent) are fitted on
the driver from at most PER_LANGUAGE labelled texts of each language in expectation, chosen by a hash of the identifier;
their vectors are computed on the executors from whole texts. Families are decided by pairwise votes among families,
languages by pairwise votes within the family; summed margins break ties, then the smaller name.

Defined results: a text that is null or has no letter is "und" with score 0. With one known language every other text gets
it with score 1; with none, everything is "und". Labels that are null are not learned. An identifier that is null counts as
the empty text in the fold rule. Repeated rows get equal results. Other columns are never looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts of each language that the classifier is fitted on, in expectation: the bound of the training sample.
PER_LANGUAGE = 500
DIMS_BITS = 12
DIMS = 1 << DIMS_BITS
UND = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes hashed at a time.
BLOCK = 1 << 20
#: Families of languages by ISO 639-1 code (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "indic": ("hi", "bn", "ur", "mr"),
}
#: Every byte but ASCII letters and those of longer characters becomes a space (parameters of the features).
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def vector(text: str) -> np.ndarray:
    """Unit vector of hashed n-grams of the whole text."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(PLAIN), dtype=np.uint8)
    counts = np.zeros(DIMS)
    for at in range(0, len(data), BLOCK):
        b = data[at : at + BLOCK + 3].astype(np.uint32)
        n = min(BLOCK, len(data) - at)
        h = b[:n] * MIX[0]
        for k in (1, 2, 3):
            h = h[: len(b) - k] + b[k : k + n] * MIX[k]
            mixed = (h ^ (h >> np.uint32(15))) * MIX[1]
            counts += np.bincount(mixed >> np.uint32(32 - DIMS_BITS), minlength=DIMS)
    root = np.sqrt(counts)
    norm = np.linalg.norm(root)
    return (root / norm if norm else root).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 40) -> np.ndarray:
    """Weights (the last one the bias) of a linear SVM with squared hinge loss by dual coordinate descent. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha, diag = np.zeros(x.shape[1]), np.zeros(len(x)), 0.5 / c
    norm = np.einsum("ij,ij->i", x, x) + diag
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + diag * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w.astype(np.float32)


def _pairwise(x: np.ndarray, labels: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    """One machine for each pair of labels; positive margins speak for the first."""
    out = {}
    for a, b in itertools.combinations(sorted(set(labels)), 2):
        own = (labels == a) | (labels == b)
        out[a, b] = fit_svm(x[own], np.where(labels[own] == a, 1.0, -1.0))
    return out


def _vote(v: np.ndarray, names: list[str], machines: dict) -> tuple[str, float]:
    """Winner of the pairwise votes among names, and how sure its own margins are (0 to 1)."""
    if len(names) == 1:
        return names[0], 1.0
    votes, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    sure = {n: [] for n in names}
    for (a, b), w in machines.items():
        m = float(v @ w[:-1] + w[-1])
        votes[a if m > 0 else b] += 1
        for n, s in ((a, m), (b, -m)):
            margins[n] += s
            sure[n].append(1 / (1 + np.exp(-4 * s)))
    best = min(names, key=lambda n: (-votes[n], -margins[n], n))
    return best, float(min(sure[best]))


class LanguageModel:
    """Fitted machines: pairs of families, and pairs of languages within each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        labels = np.array(langs, dtype=object)
        groups = np.array([family_of(x) for x in langs], dtype=object)
        self.members = {f: sorted(set(labels[groups == f])) for f in sorted(set(groups))}
        self.families = _pairwise(x, groups)
        self.within = {f: _pairwise(x[groups == f], labels[groups == f]) for f in self.members}

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.members or not LETTER.search(text):
            return UND, 0.0
        v = vector(text)
        family, s = _vote(v, list(self.members), self.families)
        lang, t = _vote(v, self.members[family], self.within[family])
        return lang, min(1.0, max(0.0, s * t))

    def column(self, text_col: str) -> Column:
        """struct(lang, score) of a text column."""
        predict = self.predict

        @F.pandas_udf("lang string, score double")
        def identify(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([predict(t) for t in texts], columns=["lang", "score"])

        return identify(F.col(text_col))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from text and label of the rows of docs that are not held out."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return LanguageModel(np.zeros((0, DIMS), np.float32), [])
    u = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv])

    @F.pandas_udf("binary")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([vector(t).tobytes() for t in texts])

    sample = rows.where(u < F.element_at(wanted, F.col("lang"))).select("lang", "id", embed("text").alias("v")).collect()
    sample.sort(key=lambda r: (r["lang"], r["id"] or "", r["v"]))
    return LanguageModel(np.array([np.frombuffer(r["v"], np.float32) for r in sample]).reshape(-1, DIMS), [r["lang"] for r in sample])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score per row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), model.column(text_col).alias("p"))
    return rows.select("id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language is known: not "und", and with at least the score asked for."""
    p = model.column(text_col)
    return docs.where((p["lang"] != UND) & (p["score"] >= least_score))
