"""Language identification in two steps: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of closely related languages; a language that is not named is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}
UNDETERMINED = "und"
SIZE = 1 << 13
_LETTER = np.zeros(256, np.uint8)
_LETTER[:] = 0x20
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
#: Bytes handled at once, so that a very long text needs no large arrays.
_BLOCK = 1 << 20


def features(text: str | None) -> np.ndarray | None:
    """Hashed counts of byte 2- and 3-grams of the whole text, damped and of length 1; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = _LETTER[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    counts = np.zeros(SIZE)
    for at in range(0, len(raw), _BLOCK):
        x = raw[at : at + _BLOCK + 2].astype(np.uint32)
        two = x[:-1] * np.uint32(256) + x[1:]
        three = two[:-1] * np.uint32(256) + x[2:] + np.uint32(1 << 24)
        for grams, last in ((two, _BLOCK), (three, _BLOCK)):
            counts += np.bincount((grams[:last] * np.uint32(2654435761)) >> np.uint32(19), minlength=SIZE)
    space = 0x2020
    counts[(space * 2654435761 & 0xFFFFFFFF) >> 19] = 0
    out = np.sqrt(counts)
    return (out / max(np.linalg.norm(out), 1e-9)).astype(np.float32)


class Rows:
    """Sparse feature vectors: the places and values of what is not zero, and where each vector starts."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray]) -> None:
        self.length = np.array([len(p) for p in places], np.int64)
        self.places = np.concatenate(places) if places else np.zeros(0, np.uint16)
        self.values = np.concatenate(values) if values else np.zeros(0, np.float32)
        self.start = np.cumsum(self.length) - self.length

    def __len__(self) -> int:
        return len(self.length)

    def take(self, chosen: np.ndarray) -> Rows:
        cut = lambda a: [a[self.start[k] : self.start[k] + self.length[k]] for k in np.flatnonzero(chosen)]
        return Rows(cut(self.places), cut(self.values))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Each vector times the weights; the last weight is the offset."""
        return np.add.reduceat(self.values * w[self.places], self.start) + w[-1]

    def sums(self, by: np.ndarray) -> np.ndarray:
        """The sum of the vectors, each multiplied by its number in ``by``, and of those numbers."""
        out = np.bincount(self.places, self.values * np.repeat(by, self.length), SIZE)
        return np.append(out, by.sum())


def _svm(x: Rows, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the offset) of a linear SVM with squared hinge loss, classes weighted alike; y is +1 or -1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, look, momentum = np.zeros(SIZE + 1, np.float32), np.zeros(SIZE + 1, np.float32), 1.0
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * x.dot(look))
        step = look - 0.25 * (penalty * look - 2 * x.sums(weight * short * y))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = step + (momentum - 1) / after * (step - w)
        w, momentum = step.astype(np.float32), after
        look = look.astype(np.float32)
    return w


class Discriminator:
    """One-versus-one linear SVMs over some classes: most votes win, then the larger sum of margins."""

    def __init__(self, x: Rows, labels: list[str]) -> None:
        self.classes = sorted(set(labels))
        named = np.array(labels)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        rows = []
        for a, b in self.pairs:
            chosen = (named == self.classes[a]) | (named == self.classes[b])
            rows.append(_svm(x.take(chosen), np.where(named[chosen] == self.classes[a], 1, -1).astype(np.float32)))
        self.weights = np.array(rows, np.float32).reshape(len(rows), SIZE + 1)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class and a score of 0 to 1: the logistic of the winner's smallest margin."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, sums, least = (np.zeros(len(self.classes)) for _ in range(3))
        least += np.inf
        for (a, b), m in zip(self.pairs, margins, strict=True):
            votes[a if m >= 0 else b] += 1
            for k, v in ((a, m), (b, -m)):
                sums[k] += v
                least[k] = min(least[k], v)
        best = max(range(len(self.classes)), key=lambda k: (votes[k], sums[k]))
        return self.classes[best], float(1 / (1 + np.exp(-3 * least[best])))


class Likeness:
    """How like its language's labelled texts a text is: the cosine with their mean, against what is usual for so many n-grams.

    A discriminator only tells languages apart; text in none of them also falls on some side. Texts of few n-grams are less like the mean, so
    the usual is taken for each power of two of n-grams: the 1 % quantile of the labelled rows, less a fifth.
    """

    SLACK = 0.8

    def __init__(self, x: Rows, langs: list[str]) -> None:
        named = np.array(langs)
        self.mean = {}
        cosine = np.zeros(len(x))
        for lang in sorted(set(langs)):
            chosen = named == lang
            mean = x.sums(chosen.astype(np.float32))[:-1]
            self.mean[lang] = (mean / max(np.linalg.norm(mean), 1e-9)).astype(np.float32)
            cosine[chosen] = x.take(chosen).dot(np.append(self.mean[lang], np.float32(0)))
        size = np.array([self.size(n) for n in x.length.tolist()])
        # Where no row has so many n-grams: what the nearest smaller texts show, or less by the root of two for each size below all rows.
        known = {s: self.SLACK * float(np.quantile(cosine[size == s], 0.01)) for s in np.unique(size).tolist()}
        least = min(known)
        self.usual = np.array([known[max(k for k in known if k <= s)] if s >= least else known[least] * 2 ** ((s - least) / 2) for s in range(self.size(SIZE) + 1)])

    @staticmethod
    def size(n: int) -> int:
        return max(n, 1).bit_length() - 1

    def of(self, x: np.ndarray, lang: str) -> float:
        """1 for a text that is as like as usual, falling to 0 with the square of its likeness."""
        usual = self.usual[self.size(int(np.count_nonzero(x)))]
        return float(min(1.0, (max(x @ self.mean[lang], 0.0) / usual) ** 2)) if usual > 0 else 1.0


class LanguageModel:
    """Family discriminator, one discriminator per family, and how like the labelled texts a text must be."""

    def __init__(self, x: Rows, langs: list[str], families: Mapping[str, str] = FAMILIES) -> None:
        self.trained = bool(langs)
        if not self.trained:
            return
        of = [families.get(lang, lang) for lang in langs]
        self.families = Discriminator(x, of)
        self.likeness = Likeness(x, langs)
        self.within = {}
        for family in self.families.classes:
            chosen = np.array([f == family for f in of])
            self.within[family] = Discriminator(x.take(chosen), [lang for lang, c in zip(langs, chosen, strict=True) if c])

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if self.trained else None
        if x is None:
            return UNDETERMINED, 0.0
        family, p = self.families.predict(x)
        lang, q = self.within[family].predict(x)
        return lang, p * q * self.likeness.of(x, lang)


def fit(docs: DataFrame, allowed: Column, *, rows_per_language: int = 400, families: Mapping[str, str] = FAMILIES) -> LanguageModel:
    """Fits on a bounded sample of the labelled rows in ``docs`` (``doc_id, text, lang``) that ``allowed`` admits.

    About ``rows_per_language`` rows of each language are drawn by a hash of ``doc_id`` and the text's length; only their
    feature vectors (6 bytes for each n-gram bucket that a text has, 49 KB at most) come to the driver. Rows without text, lang or letters teach nothing.
    With no such row the model answers ``und`` for every text.
    """
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # One row per language: bounded by the number of languages.
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel(Rows([], []), [])
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, rows_per_language / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if (v := features(text)) is not None:
                    held = np.flatnonzero(v)
                    rows.append((lang, held.astype(np.uint16).tobytes(), v[held].tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "places", "x"])

    got = known.where(drawn).select("text", "lang").mapInPandas(vectors, "lang string, places binary, x binary").collect()
    got.sort(key=lambda r: (r["lang"], r["x"], r["places"]))
    x = Rows([np.frombuffer(r["places"], np.uint16) for r in got], [np.frombuffer(r["x"], np.float32) for r in got])
    return LanguageModel(x, [r["lang"] for r in got], families)


def predict(text: Column, model: LanguageModel) -> Column:
    """``struct(lang_pred, score)`` of each whole text; the model (32 KB a classifier and a language) travels with the task.

    The score is low for text that is unlike all labelled texts, whatever the letters in it.

    NULL, empty and letterless texts give ``und`` and 0.
    """

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run(text)
