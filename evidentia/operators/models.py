"""Hooks for models: predictors, pair scorers, encoders, query embedders, stages and retrievers are given as
callables; the engine brings them batches and keeps what they return checked and in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A span that a predictor finds: start, end, type, score.
Span = tuple[int, int, str, float]
Predictor = Callable[[Sequence[str], float], Sequence[Sequence[Span]]]
Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def _in_batches(column: pa.Array, size: int) -> Iterator[list]:
    values = column.to_pylist()
    for k in range(0, len(values), size):
        yield values[k : k + size]


def predict_spans(df: DataFrame, key: str, text: str, factory: Callable[[], Predictor], threshold: float = 0.0, batch: int = 64) -> DataFrame:
    """``key, span_start, span_end, entity_type, score, surface`` that a predictor finds in texts.

    ``factory`` makes the predictor once per task, so a model is loaded where it runs. It gets ``batch``
    texts at a time and must answer for each; spans outside their text, empty ones and scores below
    the threshold are errors of the predictor and fail the job, as a silent repair would shift the
    evidence. Null texts have no spans.
    """
    kind = dict(df.dtypes)[key]
    out = f"{key} {kind}, span_start int, span_end int, entity_type string, score double, surface string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = None
        for arrow in batches:
            rows: list[tuple] = []
            predictor = predictor or factory()
            keys = arrow.column(key).to_pylist()
            done = 0
            for texts in _in_batches(arrow.column(text), batch):
                given = [t for t in texts if t is not None]
                answers = list(predictor(given, threshold)) if given else []
                if len(answers) != len(given):
                    raise ValueError(f"a predictor answered {len(answers)} of {len(given)} texts")
                found = iter(answers)
                for i, value in enumerate(texts):
                    for a, b, label, score in next(found) if value is not None else ():
                        if not 0 <= a < b <= len(value) or score < threshold:
                            raise ValueError(f"a predictor gave the span {a, b, score} of a text of {len(value)}")
                        rows.append((keys[done + i], a, b, label, float(score), value[a:b]))
                done += len(texts)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [arrow.schema.field(key).type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "span_start", "span_end", "entity_type", "score", "surface"])

    return df.select(key, text).mapInArrow(run, out)


def score_pairs(pairs: DataFrame, left: str, right: str, factory: Callable[[], Callable[[Sequence[Any], Sequence[Any]], Sequence[float]]], name: str = "score") -> DataFrame:
    """``pairs`` with a column of scores that a model gives to the values of two columns, in Arrow batches."""
    from pyspark.sql import types as T

    schema = T.StructType([*pairs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for arrow in batches:
            scorer = scorer or factory()
            scores = list(map(float, scorer(arrow.column(left).to_pylist(), arrow.column(right).to_pylist()))) if arrow.num_rows else []
            if len(scores) != arrow.num_rows:
                raise ValueError(f"a scorer answered {len(scores)} of {arrow.num_rows} pairs")
            yield pa.RecordBatch.from_arrays([*arrow.columns, pa.array(scores, pa.float64())], names=[*arrow.schema.names, name])

    return pairs.mapInArrow(run, schema)


def windows_of(tokens: Sequence[str], limit: int, step: int) -> list[Sequence[str]]:
    """Windows of ``limit`` tokens, ``step`` apart, the last one up to the end; one for a short text."""
    return [tokens[k : k + limit] for k in range(0, max(1, len(tokens) - limit + step), step)] if len(tokens) > limit else [tokens]


def encode_texts(df: DataFrame, key: str, text: str, factory: Callable[[], Encoder], limit: int = 512, step: int = 448) -> DataFrame:
    """``key, windows, embedding``: the mean of the unit vectors of a text's token windows, of length 1.

    Tokens are what stands between white space (in scripts without it, single characters). Null and
    blank texts have a null embedding. Vectors of different lengths, zeros and what is no finite
    number are errors of the encoder.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for arrow in batches:
            encoder = encoder or factory()
            parts, owners = [], []
            for i, value in enumerate(arrow.column(text).to_pylist()):
                words = (value or "").split()
                tokens = words if len(words) > 1 or not words else list(words[0])
                glue = " " if len(words) > 1 else ""
                for window in windows_of(tokens, limit, step) if tokens else ():
                    parts.append(glue.join(window))
                    owners.append(i)
            embeddings: list = [None] * arrow.num_rows
            counts = np.bincount(owners, minlength=arrow.num_rows) if owners else np.zeros(arrow.num_rows, int)
            if parts:
                vectors = np.array(list(encoder(parts)), float)
                size = np.sqrt((vectors * vectors).sum(1, keepdims=True)) if vectors.ndim == 2 else np.zeros(0)
                if vectors.ndim != 2 or len(vectors) != len(parts) or not np.isfinite(vectors).all() or not size.all():
                    raise ValueError("an encoder must give each text a finite vector of one length that is not zero")
                sums = np.zeros((arrow.num_rows, vectors.shape[1]))
                np.add.at(sums, owners, vectors / size)
                for i in np.flatnonzero(counts):
                    length = np.sqrt((sums[i] ** 2).sum())
                    embeddings[i] = (sums[i] / length).tolist() if length > 0 else None
            yield pa.RecordBatch.from_arrays([arrow.column(key), pa.array(counts, pa.int32()), pa.array(embeddings, pa.list_(pa.float64()))], names=[key, "windows", "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, windows int, embedding array<double>")


def embedded_query(text: str, embedder: Callable[[str], Sequence[float]], width: int | None = None) -> Column:
    """A query's vector as a literal; of another width than the index, or not finite, it is an error."""
    vector = [float(x) for x in embedder(text)]
    if not vector or not np.isfinite(vector).all() or (width is not None and len(vector) != width):
        raise ValueError("the query's vector does not fit the index")
    return F.array(*map(F.lit, vector))


class Stages:
    """Named steps of a pipeline, each a function from tables to a table, run in the order in which they need
    each other's results."""

    def __init__(self) -> None:
        self._steps: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}

    def add(self, name: str, needs: Sequence[str], step: Callable[..., DataFrame]) -> None:
        if name in self._steps:
            raise ValueError(f"stage {name} is there already")
        self._steps[name] = (tuple(needs), step)

    def order(self, *wanted: str) -> list[str]:
        """The stages that are needed, each after those that it needs."""
        done: list[str] = []
        open_: set[str] = set()

        def visit(name: str) -> None:
            if name in done or name not in self._steps:
                return
            if name in open_:
                raise ValueError(f"stage {name} needs itself")
            open_.add(name)
            for need in self._steps[name][0]:
                visit(need)
            done.append(name)

        for name in wanted:
            visit(name)
        return done

    def run(self, wanted: Sequence[str], **tables: DataFrame) -> dict[str, DataFrame]:
        """Results of the stages; what no stage makes must be among ``tables``."""
        have = dict(tables)
        for name in self.order(*wanted):
            needs, step = self._steps[name]
            if missing := [n for n in needs if n not in have]:
                raise ValueError(f"stage {name} lacks {', '.join(missing)}")
            have[name] = step(*[have[n] for n in needs])
        return {name: have[name] for name in wanted}
