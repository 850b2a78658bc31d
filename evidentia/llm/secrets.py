"""Secret scans through a trigram inverted index; DataFrame functions only."""

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, ascii_lower


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose group has ``least`` characters or more.

    ``tight`` is a pattern that matches nothing but the passing matches, where the group is
    the whole match; it spares the many short matches of a loose pattern.
    """

    kind: str
    pattern: str
    group: int
    least: int
    tight: str | None = None


#: The first rules, whose spans make the digest.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, tight=r"[0-9a-f]{16,}"),
)
#: Secrets that their issuers mark. Fixed values.
MARKED = (
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED |)PRIVATE KEY-----", 0, 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("git_token", r"(ghp_|gho_|ghu_|ghs_|ghr_|glpat-)[A-Za-z0-9_-]{20,}", 0, 1),
    Rule("chat_token", r"(xoxb-|xoxa-|xoxp-|xoxr-|xoxs-)[A-Za-z0-9-]{10,}", 0, 1),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}", 0, 1),
    Rule("pay_key", r"(sk_live_|rk_live_|sk_test_|rk_test_)[A-Za-z0-9]{16,}", 0, 1),
)
RULES = BASE + MARKED
#: Candidates that are sent to every task, at most, and the bytes of one.
BROADCAST_BYTES, CANDIDATE_BYTES = 64 << 20, 256
#: Matches that are walked at once.
WALK = 256

#: A query is ANDed clauses, a clause is ORed alternatives, an alternative is trigrams that must all occur.
Query = list[list[frozenset[str]]]


def _runs(tree) -> list[list[str]]:
    """Of a parsed pattern: alternatives, each the literal runs that every match of it holds, in lower case."""
    found, last = [[""]], "\0"
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [[chr(arg).lower()]]
        elif name == "SUBPATTERN":
            parts = _runs(arg[-1])
        elif name == "BRANCH":
            parts = [x for branch in arg[1] for x in _runs(branch)]
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            parts = [[*x, last] for x in _runs(arg[2])]
        elif name == "MAX_REPEAT" and arg[1] == 1:
            parts = [[""], *_runs(arg[2])]
        else:
            parts = [[last]]
        # The last run of what is before goes on in the first run of what follows; `last` ends a run.
        found = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in found for b in parts]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, one of which has all its trigrams in the lower-cased text wherever the pattern matches.

    None if some alternative has no trigram, so that the rule must scan every text.
    """
    found = set()
    for runs in _runs(re._parser.parse(pattern)):
        pieces = [p for run in runs for p in run.split("\0")]
        grams = frozenset(p[i : i + 3] for p in pieces for i in range(len(p) - 2))
        if not grams:
            return None
        found.add(grams)
    # An alternative that contains another one adds nothing.
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


#: Characters by how common they are in prose; others are rarer. Fixed values.
COMMON = " etaoinshrdlcumwfgypbvkjxqz"


def rarest(trigrams: frozenset[str]) -> str:
    """The trigram of rarest characters: its posting is looked up first."""
    return min(sorted(trigrams, reverse=True), key=lambda t: sum(len(COMMON) - COMMON.index(c) for c in t if c in COMMON))


def postings(texts: DataFrame, alternatives: list[frozenset[str]]) -> DataFrame:
    """(trigram, row): the index, restricted to what queries ask for.

    Postings are intersected from the rarest trigram of an alternative on: its other trigrams are
    looked up in the texts that have that one.
    """
    leads: dict[str, set[str]] = {}
    for a in alternatives:
        for t in a:
            leads.setdefault(t, set()).add(rarest(a))
    first = sorted({rarest(a) for a in alternatives})
    found = texts.select("row", ascii_lower(F.col("text")).alias("lower"))
    found = found.select("row", "lower", F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in first])).alias("held"))
    others = [
        F.when(F.arrays_overlap("held", F.array(*map(F.lit, sorted(own)))) & F.contains("lower", F.lit(t)), F.lit(t))
        for t, own in sorted(leads.items()) if t not in first
    ]
    if others:
        more = F.when(F.size("held") > 0, F.array_compact(F.array(*others))).otherwise(F.array().cast("array<string>"))
        found = found.select("row", F.concat("held", more).alias("held"))
    # An inner explode would push a copy of all these searches into a filter on the scan.
    return found.select("row", F.explode_outer("held").alias("trigram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame | None, set[str]]:
    """(row, kinds) of texts that a rule's trigrams do not exclude, and the kinds that have to scan all."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    full = {kind for kind, q in queries.items() if q is None}
    asked = [(kind, n, t, len(grams)) for kind, q in queries.items() if q for n, grams in enumerate(q) for t in sorted(grams)]
    if not asked:
        return None, full
    terms = texts.sparkSession.createDataFrame(asked, "kind string, alternative int, trigram string, needed int")
    met = (
        postings(texts, sorted({a for q in queries.values() for a in q or ()}, key=sorted)).join(F.broadcast(terms), "trigram")
        .groupBy("row", "kind", "alternative", "needed").agg(F.size(F.collect_set("trigram")).alias("n")).where("n = needed")
    )
    return met.groupBy("row").agg(F.collect_set("kind").alias("kinds")), full


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind, stop, keep>> of a rule's matches, from the gaps and the matches in turn."""
    pattern = rule.tight or rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"), groups.alias("group"))
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(found) - 1, F.lit(0)) / WALK).cast("int"))
    blocks = F.transform(numbers, lambda k: F.slice(steps, k * WALK + 1, F.lit(WALK)))
    empty = F.array().cast("array<struct<start:int,stop:int,size:int>>")

    def walk(done: Column, block: Column) -> Column:
        """Appending to short arrays and joining them at the end keeps the cost of many matches in bounds."""
        return F.aggregate(
            block, F.struct(done["at"].alias("at"), empty.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("at"),
                F.array_append(a["out"], F.struct(
                    (a["at"] + F.length(x["gap"])).alias("start"),
                    (a["at"] + F.length(x["gap"]) + F.length(x["match"])).alias("stop"),
                    F.length(x["group"]).alias("size"),
                )).alias("out"),
            ),
            lambda a: F.struct(a["at"].alias("at"), F.array_append(done["all"], a["out"]).alias("all")),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int,size:int>>>").alias("all"))
    return F.filter(F.flatten(F.aggregate(blocks, start, walk)["all"]), lambda x: x["size"] >= rule.least)


def _marked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans, lambda x: F.struct(x["start"], F.lit(rank), F.concat_ws(":", F.lit(kind), x["start"], x["stop"]).alias("span"))
    )


def _joined(marked: list[Column]) -> Column:
    return F.array_join(F.transform(F.array_sort(reduce(F.concat, marked)), lambda x: x["span"]), ",")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: int = len(BASE),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_<kind> of each rule, spans, base_sha256 of the spans of the first ``base`` rules.

    Each rule's pattern is turned into a Boolean query on trigrams. An inverted index of
    the queries' trigrams over the lower-cased texts gives postings, which are intersected
    per alternative and united per rule. Only candidates are matched against the rule;
    a rule without mandatory trigrams is matched against every text. Spans are
    kind:start:end in code points, end exclusive, by start and then by kind as listed.

    The candidates' keys are written to the shared folder. Where they take ``broadcast_bytes`` or less they go to
    every task and no text is shuffled; beyond that, they meet the texts in a shuffled join.

    Rows are named by id and two digests of the text, so repeated rows share postings, and
    each gets the same result. A null text is empty; a null id is an id. Other columns are
    ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    texts = texts.withColumn("row", F.struct("id", F.xxhash64("text").alias("x"), F.hash("text").alias("h")))
    found, full = candidates(texts, rules)
    if found is None:
        texts = texts.withColumn("kinds", F.array().cast("array<string>"))
    else:
        found = Scratch(docs.sparkSession).keep(found, "candidates")
        size = found.agg(F.sum(F.coalesce(F.octet_length(F.col("row.id").cast("string")), F.lit(0)) + CANDIDATE_BYTES)).first()[0] or 0
        found = found.withColumnRenamed("row", "key")
        texts = texts.join(F.broadcast(found) if size <= broadcast_bytes else found, F.col("row").eqNullSafe(F.col("key")), "left").drop("key")
    columns = {}
    none = F.array().cast("array<struct<start:int,stop:int,size:int>>")
    for r in rules:
        quick = F.col("text").rlike(r.tight or r.pattern)
        wanted = quick if r.kind in full else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) & quick
        columns[f"s_{r.kind}"] = F.when(wanted, _spans(F.col("text"), r)).otherwise(none)
    spans = texts.select("id", *[c.alias(n) for n, c in columns.items()])
    marked = [_marked(F.col(f"s_{r.kind}"), k, r.kind) for k, r in enumerate(rules)]
    return spans.select(
        F.col("id").alias(id_col), *[F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules], _joined(marked).alias("spans"),
        F.sha2(_joined(marked[:base]), 256).alias("base_sha256"),
    )
