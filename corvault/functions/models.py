"""Models as registries: image embedders, text generators, rerankers; what surrounds them is columns.

None of them is here.  Each kind has a default without a model: images get a vector of their bytes' histogram, generation and
reranking give null, which the plans take as "no answer".  A model is registered as a function on a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvault.functions import text as T

#: Functions of a batch: contents of images to vectors; prompts to answers; pairs of texts to logits.
_images: dict[str, Callable[[list[bytes]], list[np.ndarray | None]]] = {}
_generators: dict[str, Callable[[list[str]], list[str | None]]] = {}
_rerankers: dict[str, Callable[[list[tuple[str, str]]], list[float | None]]] = {}
#: Most characters of a text in requests for a title, an abstract, a file's summary, a verdict.
MOST = {"title": 3000, "abstract": 7000, "summary": 1000, "noise": 200}
#: Texts in one request for verdicts.
VERDICTS = 50


def register(kind: str, name: str, f: Callable) -> None:
    {"image": _images, "generator": _generators, "reranker": _rerankers}[kind][name] = f


def histogram(content: bytes, dim: int = 64) -> np.ndarray | None:
    """Counts of byte values in ``dim`` cells, of length one; null for no bytes."""
    if not content:
        return None
    v = np.bincount(np.frombuffer(content, dtype=np.uint8).astype(np.int64) * dim // 256, minlength=dim).astype(np.float64)
    return (v / np.linalg.norm(v)).astype(np.float32)


def embed_images(content: Column, name: str = "") -> Column:
    """Vectors of image contents by the embedder of that name, else histograms; an image that can't be read gives null."""
    f = _images.get(name)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            held = [x or b"" for x in b]
            yield pd.Series(f(held) if f else [histogram(x) for x in held])

    return embed(content)


def answers(prompt: Column, name: str = "") -> Column:
    """Answers to prompts by the generator of that name, else null."""
    f = _generators.get(name)
    if f is None:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(f(list(b)), dtype=object)

    return generate(prompt)


def reranked(query: Column, candidate: Column, name: str = "") -> Column:
    """Scores of 0 to 1 of pairs, the logistic function of a reranker's logits; null without one."""
    f = _rerankers.get(name)
    if f is None:
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, c in batches:
            yield pd.Series(f([(x or "", y or "") for x, y in zip(q, c)]), dtype="float64")

    return 1 / (1 + F.exp(-logits(query, candidate)))


def requested(c: Column, kind: str, task: str) -> Column:
    """A request over as much of a text as its kind takes."""
    return T.prompt(task, c, MOST[kind])


def verdict_requests(df: DataFrame, id_col: str, text_col: str, task: str, group: str) -> DataFrame:
    """(group, request, ids, prompt): texts of each group, ``VERDICTS`` to a request, numbered from 1 within it."""
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy(group).orderBy(id_col)) - 1
    rows = df.select(F.col(group).alias("group"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), no.alias("n")).withColumn("request", F.floor(F.col("n") / VERDICTS).cast("int"))
    item = F.concat(F.lit("["), (F.col("n") % VERDICTS + 1).cast("string"), F.lit("] "), F.substring("text", 1, MOST["noise"]))
    got = rows.groupBy("group", "request").agg(F.array_sort(F.collect_list(F.struct("n", "id", item.alias("item")))).alias("x"))
    return got.select("group", "request", F.transform("x", lambda v: v["id"]).alias("ids"), F.concat(F.lit(task + "\n\n"), F.array_join(F.transform("x", lambda v: v["item"]), "\n\n")).alias("prompt"))


def verdicts(replies: DataFrame) -> DataFrame:
    """(id, noise) from replies (ids, reply): lines of "number: YES" or "number: NO"; other lines and numbers out of range are skipped, of equal numbers the last counts."""
    line = replies.select("ids", F.posexplode(F.split("reply", "\n")).alias("at", "line"))
    parts = line.select("ids", "at", F.regexp_extract("line", r"^\s*([+-]?[0-9]+)\s*:", 1).try_cast("int").alias("n"), F.upper(F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).alias("said"))
    known = parts.where(F.col("n").between(1, F.size("ids"))).select(F.element_at("ids", F.col("n")).alias("id"), "at", F.col("said").startswith("YES").alias("noise"))
    return known.groupBy("id").agg(F.max_by("noise", "at").alias("noise"))


def top_labels(logits: Column, labels: list[str], top: int = 5) -> Column:
    """The ``top`` labels with their softmax probabilities, the most likely first, equal ones in the order of the list."""
    most = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - most))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    named = F.transform(e, lambda x, i: F.struct((-x / total).alias("p"), i.alias("i"), F.get(F.array(*map(F.lit, labels)), i).alias("label")))
    return F.transform(F.slice(F.array_sort(named), 1, top), lambda v: F.struct(v["label"].alias("label"), (-v["p"]).alias("probability")))


class Run:
    """A job under a tag, so that its progress can be read and it can be cancelled from another thread."""

    def __init__(self, spark: SparkSession, tag: str):
        self.sc, self.tag = spark.sparkContext, tag

    def __enter__(self) -> Run:
        self.sc.addJobTag(self.tag)
        return self

    def __exit__(self, *_: object) -> None:
        self.sc.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.sc.cancelJobsWithTag(self.tag)

    def progress(self) -> float:
        """The part of the tasks of the active stages that have ended; 1 where none is active."""
        t = self.sc.statusTracker()
        infos = [i for s in t.getActiveStageIds() if (i := t.getStageInfo(s)) is not None]
        total = sum(i.numTasks for i in infos)
        return sum(i.numCompletedTasks for i in infos) / total if total else 1.0


#: Where each level's part of a run over all levels begins and ends, and where a level stands at its start.
RANGES = {"public": (0.00, 0.33), "restricted": (0.33, 0.67), "confidential": (0.67, 1.00)}
STARTS = {"public": 0.05, "restricted": 0.38, "confidential": 0.72}


def overall_progress(phase: Column, level: Column, progress: Column) -> Column:
    """Progress of 0 to 1 of a run over all levels, from a level's phase and its own progress, where it says one."""
    pick = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[level]
    low, high = pick({k: a for k, (a, _) in RANGES.items()}), pick({k: b for k, (_, b) in RANGES.items()})
    own = F.when(low.isNull(), progress).otherwise(low + progress * (high - low))
    done = F.coalesce(high, F.lit(0.5))
    return F.when(progress.isNotNull(), own).when(phase.isin("done", "skipped"), done).when(phase == "start", F.coalesce(pick(STARTS), F.lit(0.0))).otherwise(F.lit(0.1))
