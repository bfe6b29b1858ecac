"""Language ID by hyperdimensional profiles.

Every letter is a random vector of +1 and -1, drawn from its code point. A letter 3-gram is the product of its letters'
vectors, the first rolled by two places and the second by one, so order counts. A text is the sum of its
3-grams' vectors, a language the sum of its training texts'. A text goes to the language with the largest
cosine, measured from the mean of the languages, which takes away what they share.
"""

from __future__ import annotations

import functools
import statistics
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

DIM, SEED = 512, 20_240_117
#: 3-grams whose vectors a worker keeps, as bytes; beyond it they are made anew. 3-grams that are added up at once.
KEPT, STEP = 30_000, 2_000
SPACE = 32


@functools.cache
def _letter_table() -> np.ndarray:
    """Code point to lower-case letter, or to itself for the marks that belong to letters; everything else is a space."""
    out = np.full(0x110000, SPACE, np.int32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(x)[0] == "M":
            out[c] = c
    return out


@functools.lru_cache(maxsize=20_000)
def _letter(code: int) -> np.ndarray:
    return np.random.default_rng((SEED, code)).integers(0, 2, DIM).astype(np.int8) * 2 - 1


def grams(text: str | None, piece: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The text's letter 3-grams as numbers with their counts, piece by piece. Words are bounded by one space; white space, digits and signs bound words."""
    text, table, tail = text or "", _letter_table(), np.array([SPACE], np.int64)
    for k in range(0, len(text) + 1, piece):
        last = k + piece > len(text)
        codes = np.concatenate((tail, table[np.frombuffer(text[k : k + piece].encode("utf-32-le", "surrogatepass"), np.uint32)], [SPACE] * last))
        codes = codes[np.concatenate(([True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)))].astype(np.int64)
        if len(codes) > 2:
            yield np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
        tail = codes[-2:]


class Vectors:
    """Vectors of 3-grams, kept for the next text."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.rows = np.empty((KEPT, DIM), np.int8)

    def _add(self, gram: int) -> int:
        a, b, c = _letter(gram >> 42), _letter((gram >> 21) & 0x1FFFFF), _letter(gram & 0x1FFFFF)
        self.rows[k := len(self.at)] = np.roll(a, 2) * np.roll(b, 1) * c
        self.at[gram] = k
        return k

    def bundle(self, text: str | None) -> np.ndarray:
        """The sum of the text's 3-gram vectors; all zero without letters."""
        out = np.zeros(DIM, np.float64)
        if not any(map(str.isalpha, text or "")):  # stops at the first letter; marks alone are none
            return out
        for ids, counts in grams(text):
            for k in range(0, len(ids), STEP):
                if len(self.at) > KEPT - STEP:
                    self.at.clear()
                rows = [at if (at := self.at.get(g)) is not None else self._add(g) for g in ids[k : k + STEP].tolist()]
                out += counts[k : k + STEP].astype(np.float32) @ self.rows[rows].astype(np.float32)
        return out


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language to prototype, from all rows with a language and a letter. One vector a language comes to the driver.

    Each task bundles its rows; what is shuffled is one vector for each task and language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sums = Vectors(), {}
        for batch in slices(batches, 100):
            texts: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, x in texts.items():
                sums[lang] = sums.get(lang, 0) + made.bundle("\n".join(x))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    known = docs.select(F.col(text_col), F.col(lang_col)).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    parts = known.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r["lang"]: v for r in sums if (v := np.array([x["x"] for x in r["v"]])).any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score for each row, with the columns named in keep. score: the best cosine, 0 if negative.

    A null text, one without letters, or a model without languages gives und and 0. Ties go to the first language in
    alphabetical order. Repeated rows give a row each; an empty table gives none; other columns are not read.
    """
    names = sorted(prototypes)
    unit = np.array([prototypes[x] / np.linalg.norm(prototypes[x]) for x in names]) if names else np.empty((0, DIM))
    centre = unit.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
    rays = unit - centre
    rays = rays / np.maximum(np.linalg.norm(rays, axis=1, keepdims=True), 1e-12)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Vectors()
        for batch in slices(batches):
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                v = made.bundle(text)
                if not v.any() or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                v = v / max(np.linalg.norm(v), 1e-12) - centre
                cosines = rays @ (v / max(np.linalg.norm(v), 1e-12))
                best = int(np.argmax(cosines.round(12)))
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, *keep, "lang_pred", "score"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["lang_pred string, score double"])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep).mapInArrow(run, schema)


def noise(languages: int, passing: float = 0.005) -> float:
    """The score that the best of so many languages reaches with a random vector by this chance: cosines spread by 1 / sqrt(DIM)."""
    return statistics.NormalDist().inv_cdf(1 - passing / max(1, languages)) / DIM**0.5


def held_out(id_col: str = "doc_id"):
    """Rows outside training: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))
