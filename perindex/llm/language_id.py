"""Language identification with a string kernel.

The kernel of two texts is the number of letter sequences of one to three letters that both
hold, over the root of the product of both numbers (a cosine of presence sets). Landmark texts
give Nyström features, one ridge regression for each language separates it from the rest, and
a batch of texts is scored by one matrix product. Sequences are told apart exactly, however
long a text or large an alphabet is; a model keeps those that its landmarks hold.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import map_columns

#: The longest sequence, and the bits of a letter: a sequence is one number of 64 bits.
LONGEST, CODE = 3, 21
#: Bounds of the fit: texts and landmarks of each language, on average. More than ``CLASSES`` languages
#: share what so many have, down to ``LEAST_TEXTS`` texts and one landmark each; none is left out.
TEXTS, LANDMARKS, CLASSES, LEAST_TEXTS = 500, 40, 200, 20
RIDGE = 1e-2
#: Texts scored by one matrix product; a text whose best score is below ``LEAST`` has no language.
BATCH, LEAST = 256, 0.3
#: The answer for a text without a letter.
UNKNOWN = "und"

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def present(text: str) -> np.ndarray:
    """The distinct sequences of a text, in order; runs of anything but letters count as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = LETTER.of(codes)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    value, found = np.zeros(len(codes), np.uint64), []
    for size in range(1, LONGEST + 1):
        # No code is 0, so sequences of different sizes differ.
        value = (value[: len(codes) - size + 1] << np.uint64(CODE)) | codes[size - 1 :]
        found.append(value)
    return np.unique(np.concatenate(found))


class Letters:
    """Which code points are letters, asked of Python once for each."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.known[codes]
        if (found == 0).any():
            for code in np.unique(codes[found == 0]):
                self.known[code] = 1 if chr(code).isalpha() else -1
            found = self.known[codes]
        return found > 0


LETTER = Letters()


class Landmarks:
    """Texts by the sequences they hold: ``places[starts[k] : starts[k + 1]]`` hold ``grams[k]``."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in sets])
        grams, places = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.starts, self.places = np.append(first, len(grams)), places[order]
        self.roots = np.sqrt(np.maximum(sizes, 1))

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """The kernel of each text with each landmark."""
        out = np.zeros((len(sets), len(self.roots)), np.float32)
        for row, grams in zip(out, sets, strict=True):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            at = at[self.grams[at] == grams]
            counts = self.starts[at + 1] - self.starts[at]
            ends = np.cumsum(counts)
            entries = np.arange(counts.sum()) + np.repeat(self.starts[at] - (ends - counts), counts)
            shared = np.bincount(self.places[entries], minlength=len(row))
            row[:] = shared / (self.roots * np.sqrt(max(len(grams), 1)))
        return out


@dataclass(frozen=True)
class Model:
    """Landmark texts and the weight of each for each language."""

    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.landmarks.kernel(sets) @ self.weights


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of a bounded sample of the labelled rows that are not held out; None if there are none.

    The sample takes about ``TEXTS`` rows of each language by a hash of id and text, and the texts
    become presence sets inside the tasks, so the driver gets eight bytes for each distinct sequence.
    Equal sets of a language are one, so copies do not outgrow the sample; null ids are as good as others.
    """
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("body"), F.col(f"`{lang}`").cast("string").alias("lang")
    ).filter(~held_out("id") & F.col("body").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in slim.groupBy("lang").count().collect()}
    if not sizes:
        return None
    span, texts = 1 << 30, max(LEAST_TEXTS, min(TEXTS, TEXTS * CLASSES // len(sizes)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(span, int(span * texts / n) + 1))])
    sample = slim.filter(F.pmod(F.xxhash64("id", "body", F.lit(7)), F.lit(span)) < F.try_element_at(share, "lang"))

    def make():
        def packed(langs: list[str], bodies: list[str]) -> dict[str, list]:
            kept = [(a, present(b).tobytes()) for a, b in zip(langs, bodies, strict=True) if has_letter(b)]
            return {"lang": [a for a, _ in kept], "grams": [b for _, b in kept]}

        return packed

    rows = map_columns(sample, [F.col("lang"), F.col("body")], make, "lang string, grams binary").distinct().collect()
    rows = sorted(((r["lang"], bytes(r["grams"])) for r in rows), key=lambda r: (zlib.crc32(r[1]), r))
    if not rows:
        return None
    return solve([r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows])


def solve(labels: list[str], sets: list[np.ndarray]) -> Model:
    share, of_language = Counter(labels), defaultdict(list)
    languages = sorted(share)
    for i, x in enumerate(labels):
        of_language[x].append(i)
    each = max(1, min(LANDMARKS, LANDMARKS * CLASSES // len(languages)))
    chosen = [sets[i] for k in languages for i in of_language[k][:each]]
    landmarks = Landmarks(chosen)
    values, vectors = np.linalg.eigh(landmarks.kernel(chosen).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström: the kernel of landmarks to the power -1/2
    features = landmarks.kernel(sets).astype(float) @ root
    # Each language weighs the same on both sides, however many texts it has.
    weighted = features / np.array([share[x] for x in labels], float)[:, None]
    gram = features.T @ weighted + RIDGE * np.eye(features.shape[1]) / len(languages)
    # Targets are 1 for the texts of a language and -1 for the others.
    sums = np.stack([weighted[of_language[k]].sum(axis=0) for k in languages], axis=1)
    weights = root @ np.linalg.solve(gram, 2 * sums - sums.sum(axis=1, keepdims=True))
    return Model(languages, landmarks, weights.astype(np.float32))


def languages(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """The language of each text and its score."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
    for at in range(0, len(known), BATCH):
        block = known[at : at + BATCH]
        found = model.scores([present(texts[i]) for i in block])
        best = found.argmax(axis=1)
        top = np.clip((1 + found[np.arange(len(block)), best]) / 2, 0, 1)
        for i, b, s in zip(block, best, top, strict=True):
            names[i], scores[i] = model.languages[b], float(s)
    return names, scores


def kept_documents(docs: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """``docs`` without texts that have no letter or that no language claims; all columns stay.

    If no row that is not held out has a label, nothing is learned, and every text with a letter stays.
    """
    model = fit(docs)

    @F.pandas_udf("boolean")
    def claimed(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series([bool(t) and has_letter(t) for t in texts], dtype=bool)
        found = zip(*languages(texts.tolist(), model), strict=True)
        return pd.Series([name != UNKNOWN and score >= least for name, score in found], dtype=bool)

    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        claimed(F.col(f"`{text}`").cast("string")).alias("claimed"),
    )
    return marked.filter("claimed").select("doc.*")


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of every text and a score from 0 to 1.

    Null texts, texts without a letter, and all texts if there is no model, are ``und`` with
    score 0. Repeated rows give repeated results, other columns are not carried. A null id is
    not held out.
    """

    def make():
        def predicted(keys: list[int], held: list[bool], texts: list[str | None]) -> dict[str, list]:
            names, scores = languages(texts, model)
            return {"doc_id": keys, "held_out": held, "lang_pred": names, "score": scores}

        return predicted

    columns = [F.col(f"`{doc_id}`").cast("long"), held_out(doc_id), F.col(f"`{text}`").cast("string")]
    return map_columns(docs, columns, make, PREDICTED, rows=500)
