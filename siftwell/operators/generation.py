"""Calls to a language model: a ledger of batches, a budget, and what the answers say.

Prompts are rows (``batch, prompt``). The ledger keeps what was sent before it is sent, and what came back, as appended Parquet, so
a run that dies is resumed: batches that were answered are never sent again, batches that failed are tried again up to a number of
attempts, and a batch whose prompt changed is another batch. Spending is bounded: calls go out in waves, and a wave is no larger
than what is left of the budget pays for.

A model is a function from a table of prompts to a table of answers: ``called`` wraps a ``Generator`` that each task makes,
``replayed`` looks answers up that were recorded earlier. Nothing here parses by hand: answers are JSON arrays in or out of
a fence, and malformed ones give no rows.
"""

from __future__ import annotations

import uuid
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import fenced_json
from siftwell.operators.indexing import with_global_index
from siftwell.operators.prompts import ABSTAIN, CONFUSION, SELECT, STANDARD, affordable, batch_prompts, valid_generated
from siftwell.sources.scratch import materialise, temporary
from siftwell.sources.splits import exists

SENT = "run string, call string, batch string, prompt string"
DONE = "run string, call string, batch string, answer string, cost double, error string"
ANSWERS = "array<struct<tool_id:string,query:string,skip:boolean,separable:boolean,distinction:string,why_unsupported:string>>"
#: Calls whose batches may be broadcast, at some 50 bytes each.
BROADCAST_CALLS = 100_000
CHOICES = "array<struct<id:string,choice:string,tied:boolean>>"


class Generator(Protocol):
    def generate(self, prompt: str) -> tuple[str, float]:
        """The answer and what it cost. An exception is a failed call."""


class Selector(Generator, Protocol):
    """A generator asked with ``selector_prompts``; its answers name one candidate, or NONE, for each request."""


def called(make_generator):
    """Answers of a live model, made once a task. A failed call is a row with its error."""

    def answers(prompts: DataFrame) -> DataFrame:
        def run(batches):
            model = make_generator()
            for b in batches:
                out = []
                for prompt in b.column("prompt").to_pylist():
                    try:
                        text, cost = model.generate(prompt)
                        out.append((text, float(cost), None))
                    except Exception as e:  # a failed call is a row with its error
                        out.append((None, 0.0, f"{type(e).__name__}: {e}"[:300]))
                columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column("call"), *columns], ["call", "answer", "cost", "error"])

        return prompts.select("call", "prompt").mapInArrow(run, "call string, answer string, cost double, error string")

    return answers


def replayed(recorded: DataFrame):
    """Answers that were recorded: ``batch, answer, cost``; a batch without one is a failed call."""

    def answers(prompts: DataFrame) -> DataFrame:
        asked = prompts.select("call", "batch")
        own = recorded.select("batch", "answer", "cost")
        if asked.count() <= BROADCAST_CALLS:  # a wave: the records stream past it
            own = own.join(F.broadcast(asked.select("batch").distinct()), "batch", "left_semi")
        found = asked.join(own, "batch", "left")
        return found.select("call", "answer", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.when(F.col("answer").isNull(), "not recorded").alias("error"))

    return answers


class Ledger:
    """Appended tables ``sent`` and ``done`` in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def sent(self) -> DataFrame:
        return self._table("sent", SENT)

    def done(self) -> DataFrame:
        return self._table("done", DONE)

    def answers(self) -> DataFrame:
        """``call, batch, answer``: one answer for each call that has any."""
        return self.done().where("answer IS NOT NULL").groupBy("call").agg(F.min("batch").alias("batch"), F.min("answer").alias("answer"))

    def spent(self) -> float:
        return float(self.done().agg(F.sum("cost")).first()[0] or 0.0)

    def stats(self) -> DataFrame:
        """``sent, answered, failed, unanswered, cost``: calls by their state, and the cost of all attempts."""
        tries = self.sent().groupBy("call").agg(F.lit(1).alias("one"))
        back = self.done().groupBy("call").agg(F.max(F.col("answer").isNotNull().cast("int")).alias("good"), F.sum("cost").alias("cost"))
        rows = tries.join(back, "call", "left")
        return rows.agg(F.count("*").alias("sent"), F.count_if(F.col("good") == 1).alias("answered"), F.count_if(F.col("good") == 0).alias("failed"), F.count_if(F.col("good").isNull()).alias("unanswered"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))

    def todo(self, prompts: DataFrame, attempts: int) -> DataFrame:
        """Calls without an answer that were sent fewer than ``attempts`` times."""
        return self._open(prompts, attempts).drop("tries")

    def _open(self, prompts: DataFrame, attempts: int) -> DataFrame:
        """``call, batch, prompt, tries`` of what is to do."""
        calls = prompts.select(F.substring(F.sha2(F.concat_ws("\n", F.col("batch").cast("string"), "prompt"), 256), 1, 24).alias("call"), F.col("batch").cast("string").alias("batch"), "prompt")
        tries = self.sent().groupBy("call").agg(F.count("*").alias("tries"))
        open_calls = calls.join(self.answers(), "call", "left_anti").join(tries, "call", "left")
        return open_calls.withColumn("tries", F.coalesce("tries", F.lit(0))).where(F.col("tries") < attempts).dropDuplicates(["call"])

    def run(self, prompts: DataFrame, answers, budget: float, cost_per_call: float, attempts: int = 2, wave: int = 1000) -> int:
        """Send what is to do, in waves in the order of the calls, while the budget pays for it; the number of calls made.

        What is to do is put in order once. A wave takes calls that failed before (no more than a wave holds, all of them earlier
        in the order) and then the next ones, so each prompt is read and sent once for each attempt, however many waves there are.
        """
        made, at, waiting, spent = 0, 0, 0, self.spent()
        with temporary(self.spark) as _:
            calls = materialise(with_global_index(self._open(prompts, attempts), [F.col("call").asc()], "place"), "calls")
            total, again = calls.count(), None
            while True:
                n = min(wave, affordable(wave, cost_per_call, budget - spent), waiting + total - at)
                if n <= 0:
                    return made
                with temporary(self.spark) as keep:
                    fresh = max(0, n - waiting)
                    now = calls.where((F.col("place") >= at) & (F.col("place") < at + fresh)).drop("place")
                    if waiting:
                        now = now.unionByName(again if waiting <= n else again.orderBy("call").limit(n))
                    now = materialise(now, "wave", n)
                    back, failed = self._send(now, answers)
                    failed = failed.withColumn("tries", F.col("tries") + 1).where(F.col("tries") < attempts)
                    if waiting > n:
                        failed = failed.unionByName(again.join(now.select("call"), "call", "left_anti"))
                    again = keep(materialise(failed, "again", wave))
                    made, at, waiting = made + n, at + fresh, again.count()
                    spent += float(back.agg(F.sum("cost")).first()[0] or 0.0)

    def _send(self, now: DataFrame, answers) -> tuple[DataFrame, DataFrame]:
        """Note calls as sent, ask, and note what came back; that, and the rows of ``now`` that have no answer."""
        run = uuid.uuid4().hex
        now.select(F.lit(run).alias("run"), "call", "batch", "prompt").write.mode("append").parquet(f"{self.path}/sent")
        back = answers(now).join(now.select("call", "batch"), "call")
        back = materialise(back.select(F.lit(run).alias("run"), "call", "batch", "answer", "cost", "error"), "answered")
        back.write.mode("append").parquet(f"{self.path}/done")
        return back, now.join(back.where("answer IS NOT NULL").select("call"), "call", "left_anti")


def standard_prompts(units: DataFrame, style: str, batch: str = "batch", pos: str = "pos", block: str = "block") -> DataFrame:
    return batch_prompts(units, F.lit(STANDARD.replace("{style}", style)), batch, pos, block)


def confusion_prompts(pairs: DataFrame, batch: str = "batch", pos: str = "pos") -> DataFrame:
    """Each row of ``pairs`` has the blocks of a target and its neighbour."""
    both = pairs.withColumn("block", F.concat(F.lit("target:\n"), F.col("target"), F.lit("\nneighbour:\n"), F.col("neighbour")))
    return batch_prompts(both, F.lit(CONFUSION), batch, pos, "block")


def abstain_prompts(units: DataFrame, n: int, batch: str = "batch", pos: str = "pos", block: str = "block") -> DataFrame:
    return batch_prompts(units, F.lit(ABSTAIN.replace("{n}", str(n))), batch, pos, block)


def selector_prompts(items: DataFrame, batch: str = "batch") -> DataFrame:
    """``items``: a row for each candidate, ``batch, id, query, slot, block``; requests in the order of their ids, candidates by slot."""
    lists = items.groupBy(batch, "id", "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "block"))), lambda x: x["block"]), "\n").alias("b"))
    asked = lists.withColumn("block", F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\nrequest: "), F.col("query"), F.lit("\n"), F.col("b")))
    return batch_prompts(asked, F.lit(SELECT), batch, "id", "block")


def generated_intents(answers: DataFrame, work: DataFrame, mode: str, level: str) -> DataFrame:
    """Intents of the answers of one mode: those with a query, about a tool of their batch (abstaining: about none), not skipped."""
    rows = answers.select("batch", F.posexplode(fenced_json(F.col("answer"), ANSWERS)).alias("at", "a")).select("batch", "at", "a.*")
    rows = rows.withColumn("query", F.trim("query"))
    if mode == "abstain":
        good, golds = rows.where("query <> ''"), F.array().cast("array<string>")
        variant, hard, separable = F.lit("unsupported"), F.lit("L3"), F.lit(None).cast("boolean")
    else:
        good, golds = valid_generated(rows, work), F.array("tool_id")
        separable = F.coalesce("separable", F.lit(True))
        variant, hard = F.when(separable, "unambiguous").otherwise("ambiguous"), F.lit(level if mode == "standard" else "L5")
    return good.select(
        F.concat_ws("_", F.lit(mode), F.lit(level), "batch", F.col("at").cast("string")).alias("intent_id"),
        "query",
        golds.alias("gold_tool_ids"),
        variant.alias("task_variant"),
        hard.alias("difficulty"),
        separable.alias("separable"),
        F.coalesce("distinction", F.lit("")).alias("distinction"),
        F.coalesce("why_unsupported", F.lit("")).alias("why_unsupported"),
        F.lit(f"gen_{mode}").alias("source"),
    )


def selected(answers: DataFrame, work: DataFrame) -> DataFrame:
    """``id, choice, tied`` of requests that their batch asked about, the first answer for each; an empty choice is NONE."""
    rows = answers.select("batch", F.posexplode(fenced_json(F.col("answer"), CHOICES)).alias("at", "a")).select("batch", "at", "a.*")
    asked = work.select(F.col("batch").cast("string").alias("batch"), F.col("id").cast("string").alias("id")).distinct()
    first = rows.join(asked, ["batch", "id"], "left_semi").groupBy("id").agg(F.min(F.struct("batch", "at", "choice", "tied")).alias("f"))
    choice: Column = F.trim(F.coalesce("f.choice", F.lit("")))
    return first.select("id", F.when((choice == "") | (F.lower(choice) == "none"), "NONE").otherwise(choice).alias("choice"), F.coalesce("f.tied", F.lit(False)).alias("tied"))
