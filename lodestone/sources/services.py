"""Scoring services behind one interface: anything that maps a batch of texts to vectors or of pairs to logits.

A client is made once in each Python worker by a factory that is shipped with the plan, and is called on Arrow batches. A call that fails
leaves nulls and its message for its rows, so that the ranking can fall back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default model and time limits in milliseconds.
EMBEDDING_MODEL, EMBEDDING_MS, RERANK_MS = "bge-m3", 10_000, 15_000
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Rerank = Callable[[str, Sequence[str]], Sequence[float]]


def limited(call: Callable[[], object], milliseconds: int) -> object:
    """The result of call, or TimeoutError after so many milliseconds; a call that hangs is left behind in its thread."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(milliseconds / 1000)
    except FutureTimeout:
        raise TimeoutError(f"no answer within {milliseconds} ms") from None
    finally:
        pool.shutdown(wait=False)


def with_vectors(queries: DataFrame, make: Callable[[], Embed], text_col: str = "text", milliseconds: int = EMBEDDING_MS, at_once: int = 32) -> DataFrame:
    """queries (query_id, text) with v and error. Each different text is sent once, at_once texts a call, and joined back; each call has the time limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for whole in batches:
            for at in range(0, len(whole), at_once):
                batch = whole.iloc[at : at + at_once]
                texts = batch["text"].tolist()
                try:
                    yield batch.assign(v=[list(map(float, x)) for x in limited(lambda texts=texts: embed(texts), milliseconds)], error=None)
                except Exception as error:  # noqa: BLE001  the service's failure is data here
                    yield batch.assign(v=None, error=str(error))

    texts = queries.select(F.col(text_col).alias("text")).where("text is not null").distinct().mapInPandas(run, "text string, v array<double>, error string")
    return queries.join(texts.withColumnRenamed("text", text_col), text_col, "left")


def with_logits(pairs: DataFrame, make: Callable[[], Rerank], milliseconds: int = RERANK_MS) -> DataFrame:
    """Rows (query_id, uuid, logit, error) for pairs (query_id, text, uuid, document), one call a query within the time limit.

    pairs are heads of ranked lists, so a query's rows are few. A wrong number of logits counts as a failure.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = group[["query_id", "uuid"]].assign(logit=None, error=None)
        try:
            found = limited(lambda: make()(group["text"].iloc[0], group["document"].tolist()), milliseconds)
            if len(found) != len(group):
                raise ValueError(f"{len(found)} logits for {len(group)} rows")
            return out.assign(logit=[float(x) for x in found])
        except Exception as error:  # noqa: BLE001
            return out.assign(error=str(error))

    return pairs.groupBy("query_id").applyInPandas(run, "query_id long, uuid long, logit double, error string")


def available(make: Callable[[], Embed]) -> bool:
    """Whether the service answers one short text."""
    try:
        return len(limited(lambda: make()(["probe"]), EMBEDDING_MS)) == 1
    except Exception:  # noqa: BLE001
        return False


def usable_modes(corpus_rows: int, stats: bool, vectors: bool, embedding: bool, reranker: bool) -> dict[str, str]:
    """Per mode an empty string, or what it lacks."""
    lack = {"corpus": corpus_rows == 0, "corpus statistics": not stats, "vectors": not vectors, "embedding service": not embedding, "re-ranking service": not reranker}
    dense, fused = ["corpus", "vectors", "embedding service"], ["corpus", "corpus statistics", "vectors", "embedding service"]
    needs = {"regex": ["corpus"], "fuzzy": ["corpus"], "semantic": dense, "hybrid": fused, "hybrid+rerank": [*fused, "re-ranking service"], "semantic+rerank": [*dense, "re-ranking service"]}
    return {mode: ", ".join(x for x in wants if lack[x]) for mode, wants in needs.items()}


def cost_minutes(unique_queries: int) -> tuple[int, int]:
    """Low and high estimate of embedding so many texts at 1 to 3 seconds each."""
    low = max(1, round(unique_queries / 60))
    return low, max(low + 1, round(3 * unique_queries / 60))
