"""Reading level of each document by smoothed unigram language models, one for each level.

The models are counted on labelled documents; every rating counts, so raters who disagree share a document.  A document
gets the level with the highest posterior likelihood of its English prose.  Texts with too little of it, other languages too,
get theirs from a second set of unigram models, whose units are the lengths of words and sentences in place of the words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.prose import english_prose

LEVELS = 5
#: Labelled documents that the models are counted on, at most; those with the least hash of their id.
MAX_LABELLED_DOCUMENTS = 5000
#: Added to each word's count, and share of the model of all levels in each level's.
PSEUDO_COUNT, SHARED = 0.5, 0.02
#: Words of English prose from which a document has a level. None has between 40 and 60; the bound lies between.
LEAST_PROSE = 50
#: Lengths from which words (letters) and sentences (words) are no longer told apart.
_LONG_WORD, _LONG_SENTENCE = 16, 12
_WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_SENTENCES = re.compile(r"[.!?…]+(?=\s|$)|\n")


def shapes(text: str | None) -> list[str]:
    """The lengths of the words and sentences of a text, as units of a unigram model that knows no language."""
    found: list[str] = []
    for sentence in _SENTENCES.split(text or ""):
        words = _WORDS.findall(sentence)
        if words:
            found += [f"#{min(len(w), _LONG_WORD)}" for w in words]
            found.append(f"#s{min(len(words) // 4, _LONG_SENTENCE)}")
    return found


@dataclass(frozen=True)
class Models:
    """Models over the words of English prose, and over the shapes of any text."""

    english: "LevelModel"
    shape: "LevelModel"


class LevelModel:
    """Log likelihood of each known word at each level, and of the levels themselves."""

    def __init__(self, counts: dict[str, list[float]], ratings: list[float]):
        self.index = {w: k for k, w in enumerate(sorted(counts))}
        table = np.array([counts[w] for w in self.index], dtype=float).reshape(-1, LEVELS)
        size = max(1, len(self.index))
        own = (table + PSEUDO_COUNT) / (table.sum(0) + PSEUDO_COUNT * size)
        every = table.sum(1, keepdims=True)
        shared = (every + PSEUDO_COUNT) / (every.sum() + PSEUDO_COUNT * size)
        self.likelihood = np.log((1 - SHARED) * own + SHARED * shared)
        self.prior = np.log((np.array(ratings, float) + 1) / (sum(ratings) + LEVELS))

    def level(self, words: list[str]) -> int:
        """Level of highest posterior; words without a count at any level say nothing. Of equal levels the lower one."""
        known = [k for k in map(self.index.get, words) if k is not None]
        return int((self.likelihood[known].sum(0) + self.prior).argmax()) + 1


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED_DOCUMENTS) -> Models:
    """Models from at most `most` labelled documents. Null and out-of-range ratings don't count."""
    rated = labels.where(f"reading_level between 1 and {LEVELS} and doc_id is not null")
    per = rated.groupBy("doc_id").agg(
        F.array(*[F.count_if(F.col("reading_level") == k) for k in range(1, LEVELS + 1)]).alias("ratings")
    )
    sample = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the broadcast side is bounded by `most`
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            seen = np.zeros(LEVELS)
            for text, ratings in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                weights = np.array(ratings, float)
                if words := english_prose(text):
                    seen += weights
                    words = words + shapes(text)
                for w in words:
                    if w in sums:
                        sums[w] += weights
                    else:
                        sums[w] = weights.copy()
            sums[""] = seen  # ratings of documents with prose
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([list(x) for x in sums.values()], pa.list_(pa.float64()))], ["word", "n"]
            )

    counted = texts.mapInArrow(count, "word string, n array<double>")
    rows = counted.groupBy("word").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(LEVELS)]).collect()
    counts = {r[0]: [float(x) for x in r[1:]] for r in rows}
    ratings = counts.pop("", [0.0] * LEVELS)
    english = {w: n for w, n in counts.items() if w[0] != "#"}
    return Models(LevelModel(english, ratings), LevelModel({w: n for w, n in counts.items() if w[0] == "#"}, ratings))


def reading_levels(documents: DataFrame, models: Models) -> DataFrame:
    """doc_id, prose_words (of English), reading_level and basis of every document, null and empty texts included.

    basis is `prose` from LEAST_PROSE words of English prose on, `shape` for other texts with any word, and `none` for null,
    empty and wordless texts, which are of level 1: there is nothing to read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: list[int] = []
            levels: list[int] = []
            bases: list[str] = []
            for value in batch.column(1):
                text = value.as_py()
                words = english_prose(text)
                sizes.append(len(words))
                if len(words) >= LEAST_PROSE:
                    basis, level = "prose", models.english.level(words)
                elif units := shapes(text):
                    basis, level = "shape", models.shape.level(units)
                else:
                    basis, level = "none", 1
                levels.append(level)
                bases.append(basis)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(levels, pa.int32()), pa.array(bases)],
                ["doc_id", "prose_words", "reading_level", "basis"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, prose_words int, reading_level int, basis string")
