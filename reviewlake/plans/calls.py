"""The model call as a batch stage: one answer a prompt, and a log of answers from which a stopped run goes on."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from reviewlake.sources.storage import stored


@dataclass
class Reply:
    """What a client may return besides a plain text."""

    content: str | None
    truncated: bool = False
    prompt_tokens: int = 0
    completion_tokens: int = 0


class Unavailable(Exception):
    """What a client raises when it can't take further calls: its task makes none any more, what it answered until then is kept."""


class CallsLeft(RuntimeError):
    """Prompts are left without an answer; the log has all others, so another run calls for these alone."""


SAID = StructType([StructField("content", StringType()), StructField("truncated", BooleanType()), StructField("prompt_tokens", LongType()), StructField("completion_tokens", LongType()), StructField("seconds", DoubleType()), StructField("error", StringType())])
#: Prompts that are answered before their answers are committed to the log.
COMMIT = 10_000


def answers(prompts: DataFrame, client_factory: Callable[[], Callable[[str], str | Reply]], keep: list[str], tasks: list[int], stops: bool) -> DataFrame:
    """keep and SAID for each prompt. A client is built once a partition; stops: once it is Unavailable, the other rows of its task are left out."""
    schema = StructType([prompts.schema[c] for c in keep] + SAID.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, up = client_factory(), True
        for b in batches:
            rows = []
            for prompt in b["prompt"] if up else ():
                began = time.monotonic()
                try:
                    reply = client(prompt)
                    reply = reply if isinstance(reply, Reply) else Reply(reply)
                    rows.append((reply.content, reply.truncated, reply.prompt_tokens, reply.completion_tokens, time.monotonic() - began, None))
                except Exception as e:  # noqa: BLE001 - any failure of a client belongs to its row
                    if stops and isinstance(e, Unavailable):
                        up = False
                        break
                    rows.append((None, False, 0, 0, time.monotonic() - began, f"{type(e).__name__}: {e}"))
            yield pd.concat([b[keep].iloc[: len(rows)].reset_index(drop=True), pd.DataFrame(rows, columns=SAID.names)], axis=1)

    return prompts.repartition(*tasks, *keep[:3]).mapInPandas(run, schema)


def review_prompts(prompts: DataFrame, client_factory: Callable[[], Callable[[str], str | Reply]], parts: int | None = None) -> DataFrame:
    """The columns of prompts but the prompt, content, truncated, tokens, seconds, error; a failure stays on its row."""
    return answers(prompts, client_factory, [c for c in prompts.columns if c != "prompt"], [parts] if parts else [], False)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """prompt_key and SAID, one row a key: a stage that was run again may have logged a second answer."""
    schema = StructType([StructField("prompt_key", StringType()), *SAID.fields])
    try:
        rows = spark.read.schema(schema).parquet(log)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.groupBy("prompt_key").agg(F.min(F.struct(*SAID.names)).alias("said")).select("prompt_key", "said.*")


def logged_answers(prompts: DataFrame, client_factory: Callable[[], Callable[[str], str | Reply]], log: str, commit: int = COMMIT, parts: int | None = None, retry_errors: bool = False) -> DataFrame:
    """As review_prompts, by way of a log: a folder of answers, each under the SHA-256 of its prompt.

    Prompts that the log has are not called for; equal prompts are called for once. The others are answered in rounds of about
    `commit` prompts, and a round's answers are committed together, so a run that dies loses the answers of one round at
    most. A client that raises Unavailable loses none: what was answered is committed, and CallsLeft tells how many are
    left. retry_errors: failures in the log are called for again.
    """
    spark = prompts.sparkSession
    keyed = stored(prompts.withColumn("prompt_key", F.sha2("prompt", 256)), "prompts")
    known = read_log(spark, log)
    done = known.where("error is null") if retry_errors else known
    todo = keyed.groupBy("prompt_key").agg(F.first("prompt").alias("prompt")).join(done.select("prompt_key"), "prompt_key", "left_anti")
    todo = stored(todo, "todo")
    left = todo.count()
    rounds = math.ceil(left / commit)
    for k in range(rounds):
        share = todo.where(F.pmod(F.xxhash64("prompt_key"), F.lit(rounds)) == k)
        wanted = share.count()
        said = stored(answers(share, client_factory, ["prompt_key"], [parts] if parts else [], True), "said")
        got = said.count()
        # One commit of files that are already written: the log gets all answers of a round or none.
        said.write.mode("append").parquet(log)
        left -= got
        if got < wanted:
            raise CallsLeft(f"{left} prompts are left without an answer; the log has all others")
    said = read_log(spark, log)
    return keyed.drop("prompt").join(said, "prompt_key").drop("prompt_key")
