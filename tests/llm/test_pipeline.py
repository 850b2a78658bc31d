import corpus_pipeline as P
from evidentia.llm.pieces import decode
from evidentia.llm.quality import classify_quality

from .test_decontaminate import brute as brute_hits
from .test_duplicates import FOLD
from .test_similar import brute as brute_similar

SF = "/root/testdata/sf0.001"
ODD = [(900001, None, "en", "s", 0), (900002, "", None, None, 0), (None, "a calm text without an id", "en", None, None),
       (None, "a calm text without an id", "en", None, None), (900003, "A calm text without an ID", "en", "s", 9)]


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, docs.schema))
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]

    good = P.quality_stage(spark, docs, SF)
    assert good.columns == docs.columns
    good = spark.createDataFrame(good.collect(), docs.schema)
    verdict = classify_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept and doc_id is not null").collect()
    assert {r.doc_id for r in verdict} == {r.doc_id for r in good.collect()} - {None}

    once = P.exact_stage(spark, good, SF)
    assert once.columns == docs.columns
    top = {}
    for r in good.collect():
        key = (r.text or "").translate(FOLD)
        top[key] = max(top.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    got = once.collect()
    assert sorted((r.text or "").translate(FOLD) for r in got) == sorted(top)
    assert all((-1 if r.doc_id is None else r.doc_id) == top[(r.text or "").translate(FOLD)] for r in got)

    once = spark.createDataFrame(got, docs.schema)
    near = P.near_stage(spark, once, SF).collect()
    # The stage's rule is a five-word Jaccard similarity of 0.8; texts without words are alike.
    rows = [(r.doc_id, r.text) for r in got if r.doc_id is not None]
    want = brute_similar(rows)[1]
    bare = [i for i, t in rows if not (t or "").split()]
    first = {i for i, c in want.items() if i == c} - set(bare) | set(sorted(bare)[:1])
    assert {r.doc_id for r in near} - {None} == first

    near = spark.createDataFrame(near, docs.schema)
    clean = P.decontamination_stage(spark, near, SF).collect()
    hits = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in near.collect()], bench) if r[-1]}
    assert {r.doc_id for r in clean} == {r.doc_id for r in near.collect()} - hits

    clean = spark.createDataFrame(clean, docs.schema)
    back = decode(P.pieces_stage(spark, clean, SF))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr)


def test_run(spark):
    got = P.run(spark, SF)
    assert got.count() == got.select("doc_id").distinct().count() > 50 and got.where("not lossless").count() == 0


def test_stages_take_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "*", "true kept", "1 id", "'x' component_id", "array(1) pieces", "0 n", "'s' salt", "0 group_size", "'h' sha", "0L fp"
    )
    for df in (docs.limit(0), docs.limit(30)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count()
        assert P.STAGES[-1][1](spark, df, SF).count() == df.count()


def test_rows_that_share_an_id_have_their_own_verdicts(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    fine = [" ".join(f"{w}{k}" for k in range(60)) for w in ("rain", "stone", "field")]
    rows = [(7, fine[0]), (7, f"{fine[1]} {bench} {fine[1]}"), (8, fine[1]), (8, fine[1]), (8, fine[1].upper()), (9, fine[2]), (None, fine[2]), (3, " ".join(fine[2].split()[:-1]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clean = sorted((r.doc_id, r.text) for r in P.decontamination_stage(spark, docs.where("doc_id = 7"), SF).collect())
    assert clean == [(7, fine[0])]
    once = [(r.doc_id, r.text.lower()) for r in P.exact_stage(spark, docs, SF).collect()]
    assert sorted(once) == sorted([(7, fine[0]), (7, rows[1][1].lower()), (8, fine[1]), (9, fine[2]), (3, rows[-1][1])])
    near = sorted((r.doc_id, r.text) for r in P.near_stage(spark, docs.where("doc_id in (3, 7, 9)"), SF).collect())
    assert near == sorted([(3, rows[-1][1]), (7, fine[0]), (7, rows[1][1])])
