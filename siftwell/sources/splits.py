"""Splits by name: which files they come from, which rows of them, and which side of a partition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.sources.tables import SCHEMAS, read_jsonl


@dataclass(frozen=True)
class Split:
    """``file`` below the registry's folder, a row filter, and the partitions that list it; ``cut``: rows follow the manifest."""

    name: str
    file: str
    where: str = "true"
    sides: tuple[str, ...] = ("dev", "test", "all")
    cut: bool = True
    schema: str = "generated_intent"


#: Anchors carry a cut of their own; generated splits are cut by the manifest.
SPLITS = (
    Split("dev_A", "dev_A.jsonl", sides=("dev",), cut=False, schema="intent"),
    Split("test_A", "test_A.jsonl", sides=("test", "all"), cut=False, schema="intent"),
    Split("C_unseen_tools", "C_unseen_tools.jsonl", sides=("test", "all"), cut=False, schema="intent"),
    *[Split(f"standard_{level}", f"standard_{level}.jsonl") for level in ("L2", "L3", "L4")],
    Split("splitD_separable", "confusion_L2.jsonl", "separable"),
    Split("splitD_inseparable", "confusion_L2.jsonl", "NOT separable"),
    Split("splitE_abstain", "abstain_L2.jsonl"),
)


@dataclass
class Registry:
    """``splits``: name to rows, in the order listed; ``absent``: names of which there is no file."""

    splits: dict[str, DataFrame] = field(default_factory=dict)
    absent: list[str] = field(default_factory=list)

    def items(self) -> DataFrame:
        """All rows under their split's name: ``split, intent_id, query, gold_tool_ids``; nothing where there is no split."""
        out = None
        for name, rows in self.splits.items():
            rows = rows.select(F.lit(name).alias("split"), "intent_id", "query", "gold_tool_ids")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no split has a file: " + ", ".join(self.absent))
        return out

    def with_gold(self, catalog: DataFrame) -> DataFrame:
        """Rows of ``items`` with ``golds``, those of their golds that ``catalog`` (``tool_id``) has, in their order.

        Splits without any gold by design (abstaining) keep all rows; rows of others that no gold is left to are dropped.
        """
        rows = self.items().withColumn("_row", F.xxhash64("split", "intent_id", "query"))
        one = rows.select("split", "intent_id", "_row", F.posexplode("gold_tool_ids").alias("_at", "tool_id"))
        known = one.join(catalog.select("tool_id").distinct(), "tool_id").groupBy("split", "intent_id", "_row").agg(F.array_sort(F.collect_list(F.struct("_at", "tool_id"))).alias("g"))
        out = rows.join(known.select("split", "intent_id", "_row", F.col("g.tool_id").alias("golds")), ["split", "intent_id", "_row"], "left").drop("_row")
        return out.where("golds IS NOT NULL OR size(gold_tool_ids) = 0").withColumn("golds", F.coalesce("golds", F.array().cast("array<string>")))

    def register(self, prefix: str = "") -> None:
        """A temporary view for each split."""
        for name, rows in self.splits.items():
            rows.createOrReplaceTempView(prefix + name)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def load_splits(spark: SparkSession, folder: str, side: str = "all", manifest: DataFrame | None = None, splits: tuple[Split, ...] = SPLITS) -> Registry:
    """The splits of ``side`` (``dev``, ``test`` or ``all``) whose files are there.

    ``manifest`` (``intent_id, side``) is needed but for ``all``; a generated split of which it leaves no row is an error, since
    the manifest is then of other files. Absent files are told, not skipped in silence.
    """
    if side not in ("dev", "test", "all"):
        raise ValueError(f"side must be dev, test or all, not {side}")
    if side != "all" and manifest is None:
        raise ValueError(f"side {side} needs the manifest of the partition")
    out = Registry()
    for s in splits:
        if side not in s.sides:
            continue
        path = f"{folder.rstrip('/')}/{s.file}"
        if not exists(spark, path):
            out.absent.append(s.name)
            continue
        rows = read_jsonl(spark, path, SCHEMAS.get(s.schema, s.schema)).where(s.where)
        if side != "all" and s.cut:
            rows = rows.join(manifest.where(F.col("side") == side).select("intent_id").distinct(), "intent_id", "left_semi")
            if rows.isEmpty():
                raise ValueError(f"{s.name}: the manifest leaves no row on side {side}; it is of other files")
        out.splits[s.name] = rows
    return out
