"""Prompts and their batches, as columns. Models are outside the engine: their answers come from a replay table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STANDARD = (
    "Write one request that a real user would make and that each operation below fulfils, in this style: {style}. "
    "Do not name the operation, its service or its parameters. Mark an operation that is too vague with skip. "
    "Answer with a JSON array of objects with tool_id, query and skip only."
)
CONFUSION = (
    "Each pair below has a target and a neighbour. Write a request that the target fulfils and the neighbour does not. "
    "If no request can tell them apart, say so in separable and write the closest one. "
    "Answer with a JSON array of objects with tool_id, query, separable and distinction only."
)
ABSTAIN = (
    "Below are operations of a catalog. Write {n} plausible requests in the same fields that none of them can fulfil. "
    "Answer with a JSON array of objects with query and why_unsupported only."
)
SELECT = "Choose the tool that fulfils each request, or NONE. Answer with a JSON array of objects with id, choice and tied only."


def tool_block(tool_id: Column, name: Column, service: Column, description: Column, params: Column, summary: Column | None = None) -> Column:
    """A tool in a prompt: caps of 60 characters for the service, 260 for the description, 8 parameters."""
    said = F.coalesce(*[F.nullif(c, F.lit("")) for c in (description, summary) if c is not None], F.lit("(no description)"))
    lines = [
        F.concat(F.lit("  tool_id: "), tool_id),
        F.concat(F.lit("  name: "), name),
        F.concat(F.lit("  service: "), F.substring(service, 1, 60)),
        F.concat(F.lit("  desc: "), F.substring(said, 1, 260)),
        F.when(F.size(params) > 0, F.concat(F.lit("  params: "), F.array_join(F.slice(params, 1, 8), ", "))),
    ]
    return F.concat_ws("\n", *lines)


def batch_prompts(rows: DataFrame, head: Column, batch: str, pos: str, block: str) -> DataFrame:
    """One prompt a batch: the head, then the blocks in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(block).alias("b")))), lambda x: x["b"]), "\n")
    return rows.groupBy(batch).agg(F.concat_ws("\n", head, body).alias("prompt"), F.count("*").alias("n"))


def affordable(batches: int, cost_per_call: float, budget: float) -> int:
    """Calls to make before a budget is used up; the rest is not sent."""
    return batches if cost_per_call <= 0 else min(batches, int(budget // cost_per_call))


def valid_generated(answers: DataFrame, work: DataFrame) -> DataFrame:
    """Generated rows with a query, not skipped, for a tool that their batch asked about."""
    good = answers.where("query IS NOT NULL AND trim(query) <> '' AND NOT coalesce(skip, false)")
    return good.join(work.select("batch", "tool_id").distinct(), ["batch", "tool_id"], "left_semi")
