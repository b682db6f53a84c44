"""User models inside Spark tasks: embedder, generator, judge.

Each takes a ``loader`` that returns the model function; it runs once per task,
and batches arrive as Arrow record batches.  Models are the user's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Prompts that a generator without a batch size gets at a time.
PIECE_BYTES = 4 << 20


def embed(
    df: DataFrame, text: str, loader: Callable[[], Callable[[list[str]], list]], name: str = "embedding"
) -> DataFrame:
    """Add the vector of a text column; other columns never enter Python.

    All vectors of a batch have one width.  A NULL text has a NULL vector and
    does not reach the model.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for batch in batches:
            known = batch.notna().to_numpy()
            vectors = np.asarray(model(batch[known].tolist()), dtype=np.float64) if known.any() else np.empty((0, 0))
            if len(vectors) != known.sum():
                raise ValueError(f"{len(vectors)} vectors for {known.sum()} texts")
            out = np.full(len(batch), None, dtype=object)
            for i, vector in zip(np.flatnonzero(known), vectors):
                out[i] = vector
            yield pd.Series(out)

    return df.withColumn(name, run(F.col(text)))


def generate(
    prompts: DataFrame,
    loader: Callable[[], Callable[..., list[list[str]]]],
    n_samples: int = 1,
    temperature: float = 1.0,
    top_p: float = 0.95,
    seed: int = 0,
    column: str = "prompt",
    batch_size: int | None = None,
    top_k: int | None = None,
    min_new_tokens: int | None = None,
    max_new_tokens: int | None = None,
) -> DataFrame:
    """``sample_id, output_idx, output`` from the user's generator.

    ``column`` is what the model reads: the prompt text or ``prompt_ids``; it gets
    at most ``batch_size`` prompts at a time, or about ``PIECE_BYTES`` of them.  The
    limits on tokens reach the model only where they are set.
    ``output_idx`` counts a sample's texts from 0; a model that returns another
    number of texts than ``n_samples`` per prompt is an error.
    """

    if batch_size is not None and batch_size < 1:
        raise ValueError("batch_size must be positive")
    if None not in (min_new_tokens, max_new_tokens) and min_new_tokens > max_new_tokens:
        raise ValueError("min_new_tokens is above max_new_tokens")
    limits = {"top_k": top_k, "min_new_tokens": min_new_tokens, "max_new_tokens": max_new_tokens}
    sampling = {"n": n_samples, "temperature": temperature, "top_p": top_p, "seed": seed}
    sampling |= {name: value for name, value in limits.items() if value is not None}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fitting = max(1, int(batch.num_rows * min(1.0, PIECE_BYTES / max(1, batch.nbytes))))
            size = batch_size or fitting
            for start in range(0, batch.num_rows, size):
                yield batch.slice(start, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loader()
        for batch in pieces(batches):
            asked = batch.column(1)
            is_list = pa.types.is_list(asked.type) or pa.types.is_large_list(asked.type)
            texts = model(list(asked.to_numpy(zero_copy_only=False)) if is_list else asked.to_pylist(), **sampling)
            if len(texts) != batch.num_rows or any(len(outs) != n_samples for outs in texts):
                raise ValueError(f"the generator must return {n_samples} texts for each prompt")
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n_samples))),
                pa.array(np.tile(np.arange(n_samples), batch.num_rows)),
                pa.array([text for outs in texts for text in outs], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "output_idx", "output"])

    heads = prompts.where("part = 0") if "part" in prompts.columns else prompts
    return heads.select(F.col("sample_id").cast("bigint"), column).mapInArrow(
        run, "sample_id bigint, output_idx bigint, output string"
    )


def judge(
    requests: DataFrame, loader: Callable[[], Callable[..., list[str]]], max_tokens: int = 512
) -> DataFrame:
    """``request_id, completion`` from the user's judge (temperature 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for batch in batches:
            said = model(batch["judge_prompt"].tolist(), temperature=0.0, max_tokens=max_tokens)
            yield pd.DataFrame({"request_id": batch["request_id"], "completion": said})

    return requests.select("request_id", "judge_prompt").mapInPandas(
        run, "request_id string, completion string"
    )
