"""Sensitive phrases: detection, slugs, reversible replacement."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import EMAIL, HAS_EMAIL, HAS_HOST, HAS_IPV4, HOST, IPV4, NAME, STOP_WORDS
from evidentia.operators.matching import count_phrases, replace_in_turn, replace_phrases
from evidentia.operators.numbering import numbered

__all__ = ["count_phrases", "replace_in_turn", "replace_phrases"]


#: Where a text can be cut: after white space, where no name goes on. No hit of phrase_hits() stands across it.
#: What comes next has to be seen, so that a window's end is no such place.
SAFE_CUT = r"(?<=\s)(?=[^\s\p{Lu}])"
PIECE = 1 << 20


def in_pieces(texts: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(key, piece, text): texts longer than ``piece`` characters in pieces of about as many, spread over tasks.

    A piece ends at the first SAFE_CUT after its size, so hits of the pieces together are those of the text;
    a text without one for so long stays together there. Only long texts are shuffled. For tables with very long texts: they are read once more.
    """
    n = F.ceil(F.length(text) / piece).cast("int")
    window = lambda i: F.substr(F.col(text), i * piece + 1, F.lit(piece))
    # The length before the cut, in characters: regexp_instr would count those beyond the first plane of Unicode twice.
    found = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(i.alias("i"), F.split(window(i), SAFE_CUT, 2).alias("p")))
    starts = F.concat(F.array(F.lit(1)), F.transform(F.filter(found, lambda x: F.size(x["p"]) > 1), lambda x: x["i"] * piece + F.length(x["p"][0]) + 1))
    long = texts.where((F.length(text) > piece) & (n > 1)).withColumn("__s", starts)
    cut = F.transform("__s", lambda b, k: F.substr(F.col(text), b, F.coalesce(F.get("__s", k + 1), F.length(text) + 1) - b))
    # As many tasks as a shuffle has: of their few rows Spark would make one task again.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = long.select(key, F.posexplode(cut).alias("piece", text)).repartition(tasks, key, "piece")
    return texts.where(F.coalesce(F.length(text) <= piece, F.lit(True))).select(key, F.lit(0).alias("piece"), text).unionByName(parts)


def phrase_hits(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phrase, type, confidence, ord): every detected phrase where it stands, once per text and kind, in one pass.

    Addresses, IPv4, hosts of three labels or more, and names of two to four capitalised words
    that no stop word opens; two words are a person, more a term. The last word of
    a person is a surname if it has four letters or more.
    """
    def found(pattern: str, group: int, kind: str, confidence: float, order: int, only: str | None = None) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        hits = F.array_distinct(F.when(F.col(text).rlike(only), hits).otherwise(F.array().cast("array<string>")) if only else hits)
        return F.transform(hits, lambda p: F.struct(p.alias("phrase"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(order).alias("ord")))

    every = F.concat(
        found(EMAIL, 0, "email", 0.95, 2, HAS_EMAIL), found(IPV4, 0, "host", 0.9, 3, HAS_IPV4), found(HOST, 0, "host", 0.8, 4, HAS_HOST), found(NAME, 1, "term", 0.6, 5)
    )
    # Texts without hits go afterwards: from a plain explode a filter would be inferred that does all the matching once more.
    hits = texts.select(key, F.explode_outer(every).alias("h")).select(key, "h.*").where("phrase is not null")
    words, name = F.split("phrase", r"\s+"), F.col("ord") == 5
    stopped = F.array_contains(F.array(*map(F.lit, STOP_WORDS)), F.get(words, F.lit(0)))
    kept = hits.where(~(name & stopped)).withColumn("type", F.when(name & (F.size(words) <= 2), "person").otherwise(F.col("type")))
    surname = F.element_at(words, -1)
    own = F.struct("phrase", "type", "confidence", "ord")
    last = F.struct(surname.alias("phrase"), F.lit("person").alias("type"), F.lit(0.5).alias("confidence"), F.lit(6).alias("ord"))
    both = F.when((F.col("type") == "person") & (F.length(surname) >= 4), F.array(own, last)).otherwise(F.array(own))
    return kept.select(key, F.explode(both).alias("h")).select(key, "h.*")


def company_phrases(companies: DataFrame, keys: list[str], company: str = "company") -> DataFrame:
    """(keys, phrase, type, confidence, ord) of each company: its name, and the capitalised words of four letters or more in a longer one."""
    words = F.filter(F.split(F.trim(company), r"\s+"), lambda w: w != "")
    one = lambda p, sure, k: F.struct(p.alias("phrase"), F.lit("org").alias("type"), F.lit(sure).alias("confidence"), F.lit(k).alias("ord"))
    tokens = F.when(F.size(words) > 1, F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike("^[A-Z]"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(one(F.col(company), 1.0, 0)), F.transform(tokens, lambda w: one(w, 0.9, 1)))
    return companies.where(F.col(company).isNotNull()).select(*keys, F.explode(every).alias("h")).select(*keys, "h.*")


def company_tokens(spark, company: str) -> DataFrame:
    """``company_phrases`` of one company."""
    return company_phrases(spark.createDataFrame([(company,)], "company string"), [])


def candidates(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(phrase, type, confidence, texts): phrases in either case are one; the earliest kind names it."""
    first = F.struct("ord", "phrase")
    return hits.groupBy(F.lower("phrase").alias("key")).agg(
        F.min_by("phrase", first).alias("phrase"), F.min_by("type", first).alias("type"), F.min_by("confidence", first).alias("confidence"),
        F.count_distinct(key).alias("texts"),
    ).drop("key")


def merge_detected(lists: DataFrame) -> DataFrame:
    """Several detected lists (ord, phrase, type, occurrences, confidence) as one: counts add up, the surest confidence stays."""
    first = F.struct("ord", "phrase", "type")
    return lists.groupBy(F.lower("phrase").alias("key")).agg(
        F.min_by("phrase", first).alias("phrase"), F.min_by("type", first).alias("type"), F.sum("occurrences").alias("occurrences"), F.max("confidence").alias("confidence")
    ).drop("key")


def rank_candidates(found: DataFrame, texts: DataFrame, company: str | None = None, text: str = "text") -> DataFrame:
    """Candidates with their occurrences over all texts, and ``rank``: most frequent, longest, then by phrase.

    Candidates that stand nowhere go, but the company's own name. Ranks come from counted ranges, not from one sorted task.
    """
    met = found.join(count_phrases(texts, found, text), "phrase").where((F.col("occurrences") > 0) | (F.col("phrase") == F.lit(company or "")))
    return numbered(met, [], [F.desc("occurrences"), F.desc(F.length("phrase")), F.asc("phrase")], "rank")


def corpus(parts: DataFrame) -> DataFrame:
    """(name, part, text) of all that can be searched in extracted parts: texts, headers and rows of tables, values of pairs.

    Cells and values are set apart by bars, so that no name runs across two of them.
    """
    lines = F.concat(F.array(F.array_join("headers", " | ", "")), F.coalesce(F.transform("rows", lambda r: F.array_join(r, " | ", "")), F.array().cast("array<string>")))
    own = (
        F.when(F.col("kind") == "text", F.col("text")).when(F.col("kind") == "table", F.array_join(lines, "\n"))
        .when(F.col("kind") == "keyvalue", F.array_join(F.map_values("pairs"), " | ", ""))
    )
    return parts.select("name", "part", own.alias("text")).where("text is not null")


def allocate_slugs(existing: DataFrame, phrases: DataFrame, prefix: str = "EV") -> DataFrame:
    """(phrase, slug) of ``phrases`` (ord, phrase, type): known ones keep their slug, others get the next numbers of their type.

    Numbers go on from the highest in use, so a gap is never filled. New phrases are numbered in ranges of their
    order, so that a type of any size is spread over many tasks.
    """
    number = F.regexp_extract("slug", r"_(\d+)$", 1).try_cast("int")
    kind = F.regexp_extract("slug", rf"^{prefix}_([A-Z0-9]+)_\d+$", 1)
    top = existing.where(kind != "").groupBy(kind.alias("category")).agg(F.max(number).alias("top"))
    known = existing.groupBy(F.lower("phrase").alias("key")).agg(F.min("slug").alias("known"))
    category = F.regexp_replace(F.upper("type"), "[^A-Z0-9]", "")
    met = phrases.withColumn("key", F.lower("phrase")).join(known, "key", "left")
    new = met.where("known is null").withColumn("category", F.when(category == "", "TERM").otherwise(category))
    new = numbered(new, ["category"], ["ord", "phrase"]).join(top, "category", "left").withColumn("n", F.col("n") + F.coalesce("top", F.lit(0)))
    digits = F.col("n").cast("string")
    slug = F.concat(F.lit(f"{prefix}_"), "category", F.lit("_"), F.lpad(digits, 2, "0"))
    slug = F.when(F.col("n") > 99, F.concat(F.lit(f"{prefix}_"), "category", F.lit("_"), digits)).otherwise(slug)
    return met.where("known is not null").select("phrase", F.col("known").alias("slug")).unionByName(new.select("phrase", slug.alias("slug")))


def validate_map(entries: DataFrame) -> DataFrame:
    """(phrase, slug, problem): empty or identical fields, slugs of several phrases, and phrases inside others."""
    e = entries.select("phrase", "slug")
    plain = e.where((F.trim("phrase") == "") | (F.trim("slug") == "")).withColumn("problem", F.lit("empty"))
    same = e.where("phrase = slug and trim(phrase) != ''").withColumn("problem", F.lit("maps to itself"))
    twice = e.join(e.groupBy("slug").agg(F.count_distinct("phrase").alias("n")).where("n > 1").drop("n"), "slug")
    twice = twice.select("phrase", "slug").withColumn("problem", F.lit("slug used twice"))
    # A phrase stands once in itself; what stands more often among all phrases is inside another.
    met = count_phrases(e.select("phrase").distinct(), e, "phrase", either_case=False).where("occurrences > 1")
    inside = e.where("phrase != ''").join(met, "phrase", "left_semi")
    return plain.unionByName(same).unionByName(twice).unionByName(inside.withColumn("problem", F.lit("inside another phrase")))


def slug_conflicts(texts: DataFrame, entries: DataFrame, text: str = "text") -> DataFrame:
    """Slugs that already stand in some text, so that replacing could not be undone; all are looked for in one pass over a text."""
    slugs = entries.select(F.col("slug").alias("phrase")).where("slug != ''")
    return count_phrases(texts, slugs, text, either_case=False).where("occurrences > 0").select(F.col("phrase").alias("slug"))


def map_lines(entries: DataFrame) -> DataFrame:
    """The map as lines of phrase, tab, slug, with escapes."""
    def esc(c: Column) -> Column:
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    return entries.select(F.concat_ws("\t", esc(F.col("phrase")), esc(F.col("slug"))).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The map of such lines; blank lines and those without a tab go."""
    def plain(c: Column) -> Column:
        # Doubled escapes step aside while the others are undone.
        for a, b in (("\\\\", "\u0000"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\u0000", "\\")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    parts = F.split("line", "\t", 2)
    return lines.where(F.size(parts) == 2).select(plain(parts[0]).alias("phrase"), plain(parts[1]).alias("slug"))


def variants(entries: DataFrame) -> DataFrame:
    """(phrase, slug) of all spellings: composed and decomposed, as given, lower, upper and title case, blanks collapsed.

    The entry that comes first (ord) has a spelling that several share.
    """
    @F.pandas_udf("array<string>")
    def forms(phrases: pd.Series) -> pd.Series:
        return phrases.map(lambda p: sorted({unicodedata.normalize("NFC", p), unicodedata.normalize("NFD", p)}))

    rows = entries.where("phrase is not null").select("ord", "slug", F.explode(forms("phrase")).alias("form"))
    title = F.regexp_replace(F.lower("form"), r"\s+", " ")
    words = F.array_join(F.transform(F.split(title, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")
    cased = F.array("form", F.lower("form"), F.upper("form"), words)
    every = F.concat(cased, F.transform(cased, lambda c: F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))))
    spelled = rows.select("ord", "slug", F.explode(F.array_distinct(every)).alias("phrase")).where("phrase != ''")
    return spelled.groupBy("phrase").agg(F.min_by("slug", "ord").alias("slug"))


def unmapped(detected: DataFrame, entries: DataFrame) -> DataFrame:
    """Detected phrases that the map lacks, in either case."""
    return detected.join(entries.select(F.lower("phrase").alias("__k")), F.lower(detected["phrase"]) == F.col("__k"), "left_anti")
