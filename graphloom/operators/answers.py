"""The language model as tables: tasks go out, answers come back, both keyed by the hash of the request. A request that was answered before is never asked again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import task_id, without_fence

EXTRACTION = "struct<nodes:array<struct<id:string,type:string,confidence:double,attributes:map<string,struct<value:string,confidence:double>>>>,edges:array<struct<type:string,`from`:string,`to`:string,confidence:double>>>"


def tasks(prompts: DataFrame) -> DataFrame:
    """task_id, system, user, label of prompts (system, user, label), each request once."""
    return prompts.select(task_id(F.col("system"), F.col("user"), F.col("label")).alias("task_id"), "system", "user", "label").distinct()


def pending(asked: DataFrame, answers: DataFrame) -> DataFrame:
    return asked.join(answers.select("task_id"), "task_id", "left_anti")


def answered(asked: DataFrame, answers: DataFrame, schema: str = EXTRACTION) -> DataFrame:
    """The tasks with answers, without code fences and parsed; parsed is null and error says why where that fails."""
    a = asked.join(answers.groupBy("task_id").agg(F.max("answer").alias("answer")), "task_id")
    p = a.withColumn("parsed", F.from_json(without_fence(F.col("answer")), schema, {"mode": "PERMISSIVE"}))
    broken = F.try_parse_json(without_fence(F.col("answer"))).isNull()
    return p.withColumn("error", F.when(F.col("answer").isNull() | (F.trim("answer") == ""), "blank").when(broken, "no JSON")).withColumn("parsed", F.when(F.col("error").isNull(), F.col("parsed")))


class Overflow(RuntimeError):
    """A request that a model finds too long."""


class Busy(RuntimeError):
    """A model that wants to be asked later."""


def patiently(model: Callable[[str, str], str], tries: int = 3, wait: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, str], str]:
    """The model asked again where its answer is blank, and after 1, 2, 4... times `wait` seconds where it is Busy. Overflow is not tried again; a last blank answer is returned."""

    def run(system: str, user: str) -> str:
        answer = ""
        for k in range(tries):
            try:
                answer = model(system, user) or ""
            except Busy:
                if k + 1 == tries:
                    raise
                sleep(min(most, wait * 2**k))
                continue
            if answer.strip():
                break
        return answer

    return run


def ask(asked: DataFrame, model: Callable[[str, str], str]) -> DataFrame:
    """task_id, answer, failure of a model(system, user), called for batches of rows where the tasks lie: answer is null where it raised, and failure says how. Write the result before using it: a lost task asks again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, failures = [], []
            for s, u in zip(b["system"], b["user"]):
                try:
                    answers.append(model(s, u))
                    failures.append(None)
                except Exception as e:  # one request's failure is a row, not the end of all
                    answers.append(None)
                    failures.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"task_id": b["task_id"], "answer": answers, "failure": failures})

    return asked.mapInPandas(run, "task_id string, answer string, failure string")


def gated(answers: DataFrame, most: int) -> DataFrame:
    """The answers as they are; RuntimeError if more than `most` failed, 0 for no limit: what an error gate is to a batch."""
    failed = answers.where("failure is not null").count() if most else 0
    if failed > most:
        raise RuntimeError(f"{failed} requests failed, more than {most}")
    return answers


def corrections(judged: DataFrame, system: str) -> DataFrame:
    """Tasks that ask again for answers found wrong: judged has task_id, user, answer, label and error (null where it is right)."""
    wrong = judged.where("error is not null")
    user = F.concat("user", F.lit("\n\nYour answer was:\n"), F.coalesce("answer", F.lit("")), F.lit("\n\nIt is wrong: "), "error", F.lit("\nAnswer again."))
    return tasks(wrong.select(F.lit(system).alias("system"), user.alias("user"), F.concat("label", F.lit(" again")).alias("label")))


def carried(chunks: DataFrame, fold: Callable[[list[str], str], list[str]]) -> DataFrame:
    """source_file, chunk_index, prior, found: a file's chunks in order, each seen with what its earlier ones gave.

    fold(prior, text) names what a chunk holds, given the names found before it. A file's chunks are a bounded group: they make one document.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: list[str] = []
        out = []
        for r in pdf.sort_values("chunk_index").itertuples():
            found = fold(known, r.text or "")
            out.append((r.source_file, r.chunk_index, list(known), found))
            known = list(dict.fromkeys([*known, *found]))
        return pd.DataFrame(out, columns=["source_file", "chunk_index", "prior", "found"])

    rows = chunks.select("source_file", "chunk_index", "text").dropDuplicates(["source_file", "chunk_index"])
    return rows.groupBy("source_file").applyInPandas(run, "source_file string, chunk_index int, prior array<string>, found array<string>")
