"""Quality rules as a ledger of bits; DataFrame functions only.

Every rule is evaluated once for each text. The ledger stores what was measured and one bit for
each rule that fails. Policies and ablations read the ledger, never the texts.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` of the ledger's measurements holds; its place in the list is its bit."""

    name: str
    fails: Callable[[], Column]


def _long(name: str) -> Column:
    return F.col(name).cast("long")


#: The first two are the base: every policy has them.
RULES = (
    Rule("few_words", lambda: _long("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * _long("n_repeat_words") > 50 * _long("n_words")),
    Rule("word_length", lambda: (_long("word_chars") < 2 * _long("n_words")) | (_long("word_chars") > 12 * _long("n_words"))),
    Rule("symbols", lambda: 10 * _long("n_symbols") > _long("n_words")),
    Rule("repeated_lines", lambda: 10 * _long("n_dup_lines") > 3 * _long("n_lines")),
    Rule("bare_words", lambda: 5 * _long("n_bare_words") > _long("n_words")),
    Rule("capitals", lambda: 10 * _long("n_capitals") > 3 * _long("word_chars")),
    Rule("bullets", lambda: 10 * _long("n_bullet_lines") > 9 * _long("n_lines")),
    Rule("cut_lines", lambda: 10 * _long("n_cut_lines") > 3 * _long("n_lines")),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A text goes if a rule of ``hard`` fails, or more than ``allowed`` of the rules of ``soft``."""

    name: str
    version: int
    hard: tuple[str, ...] = BASE
    soft: tuple[str, ...] = ()
    allowed: int = 0


POLICIES = (
    Policy("base", 1),
    Policy("general", 1, (*BASE, "word_length", "symbols", "repeated_lines", "bare_words", "capitals")),
    Policy("general", 2, (*BASE, "symbols", "bare_words", "capitals"), ("word_length", "repeated_lines", "bullets", "cut_lines"), 1),
)
#: The policy whose verdict counts unless another is asked for.
CURRENT = ("general", 2)


def _call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def _packed(words: Column, window: int, bits: Column) -> Column:
    """Every window as one number, its hash above its place, sorted; the hash gets all the bits that the places leave."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (window - 1), F.lit(0)))
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)])
    return F.sort_array(F.transform(starts, lambda _, i: _call("shiftleft", hashed(i), bits).bitwiseOR(i.cast("long"))))


def _with_twin(sorted_: Column, key: Callable[[Column], Column]) -> Column:
    """The elements of a sorted array that have a neighbour of the same key."""
    same = lambda x, y: F.coalesce(key(x) == key(y), F.lit(False))
    return F.filter(sorted_, lambda x, i: same(x, F.get(sorted_, i + 1)) | same(x, F.get(sorted_, i - 1)))


def _spelled(packed: Column, words: Column, window: int, bits: Column) -> Column:
    """The windows of such numbers by their words, sorted, with their places."""
    mask = _call("shiftleft", F.lit(1).cast("long"), bits) - 1

    def one(x: Column) -> Column:
        at = x.bitwiseAND(mask).cast("int")
        return F.struct(F.concat_ws(" ", *[F.get(words, at + k) for k in range(window)]).alias("g"), at.alias("at"))

    return F.sort_array(F.transform(packed, one))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bare_words, n_capitals, n_bullet_lines, n_cut_lines)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_BLANK))
    read = read.select("id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    only = lambda kept: F.length(F.regexp_replace("text", f"[^{kept}]+", "")).cast("long")
    read = read.select(
        "id", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: ~w.rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]"))).cast("long").alias("n_bare_words"),
        only("A-Z").alias("n_capitals"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*\x{2022}]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))).cast("long").alias("n_cut_lines"),
        F.length(F.bin(F.size("words").cast("long"))).alias("places"),
    )
    # Windows that share a hash are few in most texts; only those are compared by their words.
    words, places = F.col("words"), F.col("places")
    read = read.withColumn("packed", _packed(words, window, places))
    read = read.withColumn("twins", _with_twin(F.col("packed"), lambda x: _call("shiftrightunsigned", x, places)))
    read = read.withColumn("spelled", F.when(F.size("twins") > 0, _spelled(F.col("twins"), words, window, places)))
    read = read.withColumn("at", F.sort_array(F.transform(_with_twin(F.col("spelled"), lambda x: x["g"]), lambda x: x["at"])))
    at = F.col("at")
    steps = F.transform(at, lambda x, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(at, i - 1))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return read.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines", "n_bare_words", "n_capitals",
        "n_bullet_lines", "n_cut_lines",
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements of every row of ``docs`` with ``bits``, one for each rule that fails; stored in the shared folder."""
    if len(rules) > 63:
        raise ValueError("a ledger has 63 bits")
    bits = [F.when(r.fails(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(rules)]
    found = measured(docs, id_col, text_col).withColumn("bits", reduce(lambda a, b: a.bitwiseOR(b), bits))
    return Scratch(docs.sparkSession).keep(found, "ledger")


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in set(names))


def verdict(bits: Column, policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a policy keeps what failed the rules of ``bits``."""
    hard = bits.bitwiseAND(F.lit(mask_of(policy.hard, rules)).cast("long")) == 0
    return hard & (F.bit_count(bits.bitwiseAND(F.lit(mask_of(policy.soft, rules)).cast("long"))) <= policy.allowed)


def apply_policies(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``entries`` of a ledger with ``kept_<name>_<version>`` of every policy."""
    return entries.withColumns({f"kept_{p.name}_{p.version}": verdict(F.col("bits"), p, rules) for p in policies})


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per policy and rule of it: rows, failing, kept, and what would change without the rule.

    ``failing`` fail the rule, ``only_here`` would be kept without it, and ``kept_without`` is kept then. Rows of
    equal bits are counted first, within each task and then over all, so that what meets
    the policies is a row for each pattern of bits, two to the number of rules at most.
    """
    patterns = entries.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [
        (p.name, p.version, r.name, 1 << k, mask_of(p.hard, rules), mask_of(p.soft, rules), p.allowed)
        for p in policies for k, r in enumerate(rules) if r.name in (*p.hard, *p.soft)
    ]
    names = ["policy", "version", "rule", "bit", "hard", "soft", "allowed"]
    table = entries.sparkSession.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows))))))
    met = patterns.crossJoin(F.broadcast(table))  # a row for each rule of each policy

    def kept(bits: Column) -> Column:
        return (bits.bitwiseAND(F.col("hard")) == 0) & (F.bit_count(bits.bitwiseAND(F.col("soft"))) <= F.col("allowed"))

    bits, n = F.col("bits"), F.col("n")
    now, then = kept(bits), kept(bits.bitwiseAND(F.bitwise_not("bit")))
    total = lambda c, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    return met.groupBy("policy", "version", "rule").agg(
        F.sum(n).alias("rows"), total(bits.bitwiseAND(F.col("bit")) != 0, "failing"), total(now, "kept"), total(then, "kept_without"), total(then & ~now, "only_here"),
        F.bit_or(F.when(then & ~now, bits).otherwise(F.lit(0).cast("long"))).alias("failing_beside"),
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policies: tuple[Policy, ...] = POLICIES,
    current: tuple[str, int] = CURRENT, rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, bits, other measurements and each policy's verdict.

    Words are runs of characters other than the six ASCII blanks, lines are cut at \\n and count if they have a word.
    ``n_dup_lines`` are equal to an earlier line of the text, character for character; ``n_repeat_words`` stand
    in a window of three words that is found twice or more in the text, the first time included. ``base_failed``: a base rule
    fails. ``kept`` is the verdict of the policy ``current``, and false wherever the base fails.

    A null text has no words, so that it fails by few_words. A null id is an id; repeated rows get the same result each. Texts may have
    any length; no rule is cut short. Other columns are ignored. An empty table gives an empty result.
    """
    entries = apply_policies(ledger(docs, id_col, text_col, rules), policies, rules)
    base_failed = F.col("bits").bitwiseAND(F.lit(mask_of(BASE, rules)).cast("long")) != 0
    chosen = next(p for p in policies if (p.name, p.version) == current)
    return entries.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & verdict(F.col("bits"), chosen, rules)).alias("kept"), "bits", "n_lines", "n_bare_words", "n_capitals", "n_bullet_lines", "n_cut_lines",
        *[f"kept_{p.name}_{p.version}" for p in policies],
    )
