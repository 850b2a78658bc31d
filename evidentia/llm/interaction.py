"""Filter interaction audit: every order of the filters is replayed over every document."""

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, look_up

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: Documents that one task replays.
TASK_ROWS = 200_000


def orders(spark: SparkSession, letters: str = FILTERS) -> DataFrame:
    """(number, filter_order, bits): all orders of the filters; ``bits`` has each step's filter as a bit. 120 rows for five filters."""
    every = ["".join(x) for x in permutations(letters)]
    bits = [[1 << letters.index(c) for c in x] for x in every]
    return spark.createDataFrame(pa.table({
        "number": pa.array(range(len(every)), pa.int32()), "filter_order": every, "bits": pa.array(bits, pa.list_(pa.int32())),
    }))


def _mask(failures: list[Column]) -> Column:
    bits = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failures)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def flags(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """(part, mask, good, toxic), one row per row of ``docs``; bit k of ``mask`` is set where filter k fails.

    A: fewer than 50 words. B: less than 65 % of the words are different. C: more than 5 % capitals A-Z. D: a mark
    of ``#$%&*|``. E: the same text stands at a smaller id. Each text is read once; what is kept of it, its mask and
    digests (SHA-256, XXH64 and length, which name it from here on), lies in the shared folder.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    own = [
        n < 50,
        100 * F.size(F.array_distinct("words")) < 65 * n,
        F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.length("text"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    digest = [F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("xx"), F.octet_length("text").alias("size")]
    facts = scratch.keep(read.select("id", "part", _mask(own).alias("own"), *digest, F.monotonically_increasing_id().alias("row")), "facts")

    keys = ["sha", "xx", "size"]
    groups = facts.groupBy(*keys).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    met = look_up(facts, groups, keys, "n", facts.count(), "row")
    mask = F.col("own").bitwiseOR(F.when(F.col("id") > F.col("first"), F.lit(1 << 4)).otherwise(F.lit(0)))

    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.bool_or(F.coalesce(F.col(quality_col) == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("toxic")
    ).withColumn("spread", F.lit(0).cast("long"))
    # Rows without an id have no label; they are spread, not gathered as one key.
    rows = met.select("id", "part", mask.alias("mask"), F.when(F.col("id").isNull(), F.col("row")).otherwise(F.lit(0)).alias("spread"))
    return rows.join(marks, ["id", "spread"], "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )


def step_counts(flagged: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order (its number) and step: what the step's filter does there, without ``shapley``; see ``filter_audit``.

    Every document's mask meets every order (120 rows, in every task), each meeting is exploded into its steps, and the
    first step whose filter fails is where the document goes. Counts are added up within each task
    before anything is shuffled, so that what is shuffled is a row per task, part, order and step: no part is a task's alone.
    """
    n = len(letters)
    played = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession, letters)))
    bits, mask = F.col("bits"), F.col("mask")
    first = F.lit(n + 1)
    for k in range(n, 0, -1):
        first = F.when(mask.bitwiseAND(F.element_at(bits, k)) != 0, F.lit(k)).otherwise(first)
    steps = played.withColumn("first", first).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, n + 1)])))
    bit = F.element_at("bits", F.col("step"))
    fails, here = mask.bitwiseAND(bit) != 0, F.col("first") == F.col("step")
    return steps.groupBy("part", "number", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(mask == bit).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )


def replay(flagged: DataFrame, letters: str = FILTERS) -> DataFrame:
    """``step_counts`` with the orders' names, and each filter's removals over all orders."""
    counted = Scratch(flagged.sparkSession).keep(step_counts(flagged, letters), "counted")  # used twice below
    named = counted.join(F.broadcast(orders(flagged.sparkSession, letters).select("number", "filter_order")), "number")
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    # A filter's removals over all orders: as many rows of a part as there are orders, whatever the part's size.
    shares = named.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return named.withColumn("letter", letter).join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: counts of documents, zeros included.

    ``kept`` are left after the step and ``removed`` go there; ``redundant`` fail its filter but went before, ``unique_fails``
    fail its filter alone; ``good_lost`` and ``toxic_lost`` are those of ``removed`` that some row of ``labels`` calls good
    (quality 1) or toxic (1); ``shapley`` is what its filter removes in all orders together.

    A null text is empty: it has no words, fails A, and equals other empty texts. A null part is the empty one. A row
    with a null id has no label and is no earlier or later than others: it neither fails E nor makes others fail.
    Rows that share an id and a text do not fail E by each other. Repeated rows count each; labels of several rows of
    an id are united, and null labels say nothing. Other columns of either table are ignored. Without documents, no rows.
    """
    spark = docs.sparkSession
    flagged = Scratch(spark).keep(flags(docs, labels, id_col, text_col, part_col), "flags")
    # A document is a few bytes here and 600 rows of work: the number of tasks follows from rows, not from bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-flagged.count() // TASK_ROWS))
    return replay(flagged.repartition(tasks))
