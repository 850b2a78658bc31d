"""Settings of the engine: rates, thresholds, trust, and the default profile of signals."""

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rates:
    """List prices and the hours of a billing month."""

    per_hour: float = 0.0807
    per_gb_month: float = 0.1156
    hours_per_month: float = 730.0


@dataclass(frozen=True)
class Sizing:
    conservative: int = 2
    aggressive: int = 3
    multipliers: tuple[int, int] = (2, 3)
    restore_base_hours: float = 1.0
    restore_hours_per_tb: float = 0.2


@dataclass(frozen=True)
class Thresholds:
    missing: float = 0.2
    engineering: float = 0.7
    engineering_mean: float = 0.69


@dataclass(frozen=True)
class Settings:
    rates: Rates = field(default_factory=Rates)
    sizing: Sizing = field(default_factory=Sizing)
    thresholds: Thresholds = field(default_factory=Thresholds)


# Derivation method, cap of its confidence, rank of trust.
METHODS = (
    ("numeric-series", 1.0, 6),
    ("keyvalue", 1.0, 5),
    ("table-lookup", 1.0, 4),
    ("manual", 1.0, 7),
    ("llm-text", 0.75, 2),
    ("vision", 0.7, 3),
    ("heuristic", 0.6, 1),
    ("assumption-default", 0.5, 0),
)

# Cluster tier and its processors per node.
TIERS = (
    ("M10", 2), ("M20", 2), ("M30", 2), ("M40", 4), ("M50", 8), ("M60", 16), ("M80", 32), ("M140", 48), ("M200", 64), ("M300", 96),
)

# Signal, kind of value, criticality, defaultable, critical to cost, methods, aliases.
SIGNALS = (
    ("cluster.shardCount", "scalar", "required", False, False, ("keyvalue", "table-lookup", "llm-text", "vision"), ("shards", "shard count", "number of shards", "sh.status")),
    ("node.hoVcpu", "scalar", "required", False, False, ("keyvalue", "table-lookup", "llm-text", "vision"), ("hovcpu", "cores per node", "vcpu per node", "primary cores", "node cores")),
    ("node.drVcpu", "scalar", "required", True, False, ("keyvalue", "table-lookup", "llm-text", "vision"), ("drvcpu", "dr cores", "dr vcpu", "dr region cores")),
    ("util.primary", "avgPeak", "required", False, False, ("numeric-series", "vision", "manual"), ("system cpu", "cpu utilization", "process cpu", "primary cpu", "cpu percent")),
    ("util.hoSec", "avgPeak", "required", True, False, ("numeric-series", "vision", "manual"), ("secondary cpu", "ha secondary cpu", "electable secondary cpu", "secondary system cpu")),
    ("util.dr", "avgPeak", "required", True, False, ("numeric-series", "vision", "manual"), ("dr cpu", "dr region cpu", "disaster recovery cpu", "dr system cpu")),
    ("data.storageSizeGb", "scalar", "required", True, True, ("keyvalue", "table-lookup", "llm-text", "numeric-series", "vision"), ("storage size", "storagesize", "disk usage", "compressed data size")),
    ("topology.nodesPerShard", "scalar", "recommended", True, False, ("keyvalue", "table-lookup", "llm-text"), ("nodes per shard", "replica set members", "rs members", "members per shard")),
    ("data.logicalSizeGb", "scalar", "recommended", True, True, ("keyvalue", "table-lookup", "llm-text", "numeric-series"), ("logical data size", "data size", "datasize", "db.stats datasize")),
    ("data.indexSizeGb", "scalar", "recommended", True, False, ("keyvalue", "table-lookup", "numeric-series"), ("index size", "indexsize", "total index size")),
    ("workingSetGb", "scalar", "recommended", True, False, ("numeric-series", "vision", "llm-text"), ("working set", "working set size", "hot data size", "cache working set")),
    ("node.ramGb", "scalar", "recommended", True, False, ("keyvalue", "table-lookup", "llm-text"), ("node ram", "ram per node", "memory per node", "wiredtiger cache size")),
    ("node.atlasTier", "enum", "recommended", True, False, ("vision", "llm-text", "keyvalue"), ("instance size", "cluster tier", "atlas tier", "instancesize", "tier")),
    ("disk.iops", "avgPeak", "recommended", True, False, ("numeric-series", "vision"), ("disk iops", "iops", "disk io", "io operations")),
    ("workload.opsPerSec", "avgPeak", "recommended", True, False, ("numeric-series", "vision", "llm-text"), ("ops per sec", "opcounters", "operations per second", "ops/sec")),
    ("workload.concurrency", "avgPeak", "recommended", True, False, ("numeric-series", "vision"), ("concurrency", "active connections", "connections", "active tickets")),
    ("workload.oplogGbPerHour", "scalar", "recommended", True, False, ("numeric-series", "keyvalue", "llm-text"), ("oplog gb/hour", "oplog churn", "oplog throughput", "oplog gb per hour")),
    ("mongo.edition", "enum", "recommended", True, False, ("llm-text", "keyvalue", "vision"), ("mongodb edition", "edition", "enterprise advanced", "community edition")),
    ("workload.readPreference", "enum", "recommended", True, False, ("llm-text", "keyvalue"), ("read preference", "readpreference", "reads to secondaries", "secondary reads")),
    ("growth.annualPct", "scalar", "recommended", True, False, ("llm-text",), ("growth rate", "annual growth", "yearly growth", "data growth")),
    ("dr.posture", "enum", "recommended", True, False, ("llm-text", "keyvalue"), ("dr posture", "disaster recovery", "dr strategy", "bcp")),
    ("data.collectionProfile", "scalar", "optional", True, False, ("keyvalue", "table-lookup", "llm-text"), ("collection profile", "collstats", "per-collection breakdown", "collection stats")),
    ("network.egressGbMonth", "scalar", "optional", True, False, ("numeric-series", "vision"), ("network egress", "egress", "network throughput", "egress gb/month")),
    ("workload.peakWindow", "enum", "optional", True, False, ("numeric-series", "vision", "llm-text"), ("peak window", "peak hours", "batch window", "peak period")),
)


# Signals as people read them.
LABELS = (
    ("cluster.shardCount", "Shard count (data-bearing replica-set count)"),
    ("node.hoVcpu", "vCPU per data-bearing node — home/primary region"),
    ("node.drVcpu", "vCPU per data-bearing node — DR region"),
    ("util.primary", "System-CPU utilization — primary role (avg & peak)"),
    ("util.hoSec", "System-CPU utilization — home-region HA secondary (avg & peak)"),
    ("util.dr", "System-CPU utilization — DR region (avg & peak)"),
    ("data.storageSizeGb", "On-disk (compressed) storage size"),
    ("topology.nodesPerShard", "Data-bearing nodes per shard (replica-set members)"),
    ("data.logicalSizeGb", "Logical data size"),
    ("data.indexSizeGb", "Total index size"),
    ("workingSetGb", "Working-set size"),
    ("node.ramGb", "RAM per data-bearing node"),
    ("node.atlasTier", "Atlas cluster tier (M10–M300)"),
    ("disk.iops", "Disk IOPS (avg & peak)"),
    ("workload.opsPerSec", "Operations per second (avg & peak)"),
    ("workload.concurrency", "Concurrency (avg & peak)"),
    ("workload.oplogGbPerHour", "Oplog churn"),
    ("mongo.edition", "MongoDB edition"),
    ("workload.readPreference", "Read preference"),
    ("growth.annualPct", "Annual growth rate"),
    ("dr.posture", "DR posture"),
    ("data.collectionProfile", "Per-collection profile"),
    ("network.egressGbMonth", "Network egress"),
    ("workload.peakWindow", "Peak window"),
)

# Kinds of what people say, of databases' licences, and of recovery.
CONTEXT_KINDS = ("concern", "objection", "timeline", "positioning")
POSTURES = ("none", "cold", "warm")
QUALITIES = ("published", "synthesized", "training-cutoff")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a local relation, whose size the planner knows, so that it can broadcast them."""
    names = [column.split()[0] for column in schema.split(", ")]
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, row)) for row in rows]), schema)


def label_table(spark: SparkSession, labels: tuple = LABELS) -> DataFrame:
    return small_table(spark, list(labels), "signal_id string, label string")


#: How a person can deliver what a method reads.
DELIVERIES = (
    ("keyvalue", "a list of settings"), ("table-lookup", "a table"), ("numeric-series", "measurements over time"), ("vision", "a picture of the chart"),
    ("llm-text", "a sentence in a mail or note"), ("manual", "your own figure"),
)


def request_table(spark: SparkSession, signals: tuple = SIGNALS, labels: tuple = LABELS) -> DataFrame:
    """signal_id, request, why: what to ask for, in which forms it can be delivered, and what hangs on it."""
    names, forms = dict(labels), dict(DELIVERIES)
    rows = []
    for signal, _, criticality, _, costly, methods, _ in signals:
        why = "Without it there is no size" if criticality == "required" else "Costs hang on it" if costly else "It makes the estimate surer"
        rows.append((signal, f"{names.get(signal, signal)}: {' or '.join(forms[m] for m in methods)}", why))
    return small_table(spark, rows, "signal_id string, request string, why string")


def signal_table(spark: SparkSession, signals: tuple = SIGNALS) -> DataFrame:
    """signal_id, value_kind, criticality, defaultable, tco_critical, derivable_by, aliases, ord."""
    rows = [(*s[:5], list(s[5]), list(s[6]), k) for k, s in enumerate(signals)]
    return small_table(
        spark, rows,
        "signal_id string, value_kind string, criticality string, defaultable boolean, tco_critical boolean, "
        "derivable_by array<string>, aliases array<string>, ord int",
    )


def method_table(spark: SparkSession, methods: tuple = METHODS) -> DataFrame:
    return small_table(spark, list(methods), "method string, cap double, trust int")


def tier_table(spark: SparkSession, tiers: tuple = TIERS) -> DataFrame:
    return small_table(spark, list(tiers), "tier string, vcpu int")
