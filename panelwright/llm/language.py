"""Language ID by error-correcting output codes.

Each learned language has a codeword; each bit has a binary classifier, a naive
Bayes model of hashed letter trigrams for the languages with that bit against
the others.  Trigram counts per language are summed by partition and then in two
streamed levels, and the bit models come from those counts.  A text's evidence on
a bit is its mean log-odds times a bounded text length; decoding adds, for each
codeword, the logistic losses of its bits, weighed by how well the bit separates
its languages, and takes the least loss.  A text whose best two losses are close
is flagged as ambiguous.

Defined results: ``und`` with score 0 for null texts, texts without a letter and
where no language was learned; null languages and rows without text are not
learned from; ties go to the smaller language name; rows are predicted one by one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .support import held_out, partition_sums, table, tidied_batches

SLOTS = 1 << 15
LONGEST = 60.0  # trigrams that count as evidence at most
AMBIGUOUS = 1.0  # nats between the best two codewords
SHORT_CODE = 5  # languages up to which the code is exhaustive

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = _ASCII_LETTER[65:91] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of the letter trigrams of each row; those of separators alone are left out."""
    low = _LETTER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    own = (row[:-2] == row[2:]) & (low[1:-1] != 32)
    code = code[own]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    return slot, row[:-2][own]


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a row has a letter of any alphabet."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    for r in np.flatnonzero(~out & (wide[offsets[1:]] > wide[offsets[:-1]])):
        out[r] = any(c.isalpha() for c in column[int(r)].as_py())
    return out


def codewords(n: int) -> np.ndarray:
    """n x bits matrix of +1 and -1: exhaustive for few languages, else the best of many seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= SHORT_CODE:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, np.int8).T
    rng = np.random.Generator(np.random.PCG64(n))
    bits, best, far = max(15, int(np.ceil(10 * np.log2(n)))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0, dtype=int)) < n]
        apart = ((code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2 + code.shape[1] * np.eye(n, dtype=int)).min()
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    log_odds: np.ndarray  # bits x SLOTS
    weight: np.ndarray  # of each bit

    def losses(self, evidence: np.ndarray) -> np.ndarray:
        """Rows x languages losses of rows x bits evidence."""
        out = np.zeros((len(evidence), len(self.languages)))
        for k, word in enumerate(self.code):
            out[:, k] = (np.logaddexp(0, -evidence * word) * self.weight).sum(1)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of each row."""
        n = len(offsets) - 1
        slot, row = trigrams(data, offsets)
        count = np.bincount(row, minlength=n)
        factor = np.minimum(count, LONGEST) / np.maximum(count, 1)
        evidence = np.stack([np.bincount(row, weights=w[slot], minlength=n) for w in self.log_odds], 1) * factor[:, None]
        loss = self.losses(evidence)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / p.sum(1)
        gap = np.partition(loss, 1, axis=1)[:, 1] - loss.min(1) if loss.shape[1] > 1 else np.full(n, np.inf)
        return best, score, gap < AMBIGUOUS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        lang = b.column("lang").dictionary_encode()
        names, of = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        for k, name in enumerate(names):
            data, offsets = tk.buffers(b.column("text").filter(pa.array(of == k)))
            sums.setdefault(name, np.zeros(SLOTS, np.int64))
            for _, _, part, at in tk.chunks(data, offsets):
                sums[name] += np.bincount(trigrams(part, at)[0], minlength=SLOTS)
    if sums:
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.string()), "blob": pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())})


def _identified(shared):
    """Batches without the rows that are in no language or as good as tied between two."""
    predict = _predicted(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = next(predict(iter([b.select(["text"])])))
            und = pa.array([x == "und" for x in found.column("lang_pred").to_pylist()], pa.bool_()).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(~und & ~found.column("ambiguous").to_numpy(zero_copy_only=False)))

    return run


def learn(texts: DataFrame) -> Model | None:
    """``texts``: lang, text, neither null."""
    counts = partition_sums(texts.select("lang", "text").mapInArrow(tidied_batches(_counted), "key string, blob binary"), "<i8")
    counts = {k: v for k, v in counts.items() if v.sum()}
    if not counts:
        return None
    languages = sorted(counts)
    p = np.stack([(counts[k] + 0.5) / (counts[k].sum() + 0.5 * SLOTS) for k in languages])
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((1, SLOTS), np.float32), np.ones(1))
    odds = np.stack([np.log(p[b > 0].mean(0)) - np.log(p[b < 0].mean(0)) for b in code.T])
    # A bit weighs as the evidence it gives for the language that it separates worst.
    apart = np.array([min((p[k] * o).sum() * code[k, j] for k in range(len(languages))) for j, o in enumerate(odds)])
    weight = np.maximum(apart, 1e-3)
    return Model(languages, code, odds.astype(np.float32), weight / weight.mean())


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            column = b.column("text")
            data, offsets = tk.buffers(column)
            letters = np.zeros(b.num_rows, bool)
            best, score, unsure = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            for i, j, part, at in tk.chunks(data, offsets) if model else ():
                letters[i:j] = has_letter(column.slice(i, j - i), part, at)
                best[i:j], score[i:j], unsure[i:j] = model.predict(part, at)
            known = letters & (model is not None)
            names = np.array([*(model.languages if model else []), "und"], object)
            yield b.append_column("lang_pred", pa.array(names[np.where(known, best, len(names) - 1)], pa.string())).append_column("score", pa.array(np.where(known, score, 0.0))).append_column("ambiguous", pa.array(~known | unsure))

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score, ambiguous; these names must be free in ``docs``."""
    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(tidied_batches(_predicted(docs.sparkSession.sparkContext.broadcast(model))), out)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, ambiguous.  Rows held out are not learned from."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn(own.filter("not held_out and lang is not null and text is not null"))
    return identify(own.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without texts in no language: those ``und``, and those whose best two languages are as good as tied."""
    model = learn(docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    return docs.mapInArrow(tidied_batches(_identified(docs.sparkSession.sparkContext.broadcast(model))), docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))
