import zlib

import pytest

import zstandard

from evidentia.llm.language import Limits, identify, language_id, learn, normal

TRAIN = {"en": "the house of the rising sun and the river that ran", "de": "der Hund und die Katze sind nicht im Garten gewesen"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language_id(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
    out = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in out)
    assert right / len(out) >= 0.97
    wide = [r for r in out if not got[r.doc_id].rejected]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in wide) / len(wide) >= 0.99


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "123 -- !?", "de"), (4, "The river and the house " * 20000, "xx"), (5, "nicht der Hund im Garten", None),
            (5, "nicht der Hund im Garten", None), (None, "und die Katze sind", "de")]
    df = spark.createDataFrame([(i, t, l, 0.5, True) for i, t, l in rows], "doc_id long, text string, lang string, score double, held_out boolean")
    model = {k: normal(v) for k, v in TRAIN.items()}
    got = identify(df, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de"), (None, "de")]
    assert all(r.rejected for r in got[:3])
    assert {r.lang_pred for r in identify(df, {}).collect()} == {"und"}
    assert language_id(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="languages"):
        language_id(df, limits=Limits(languages=1))


def test_no_language_is_left_out(spark):
    rows = [(f"{chr(97 + k // 26)}{chr(97 + k % 26)}word " * 5, f"l{k}") for k in range(300)]
    assert len(learn(spark.createDataFrame(rows, "text string, lang string"), Limits(texts=600))) == 300


def test_inputs_are_texts_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    a = {r.doc_id: r.lang_pred for r in language_id(docs).collect()}
    flipped = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'zz', lang) lang")
    assert a == {r.doc_id: r.lang_pred for r in language_id(flipped).collect()}


def test_copies_do_not_thin_the_training_sample(spark):
    rows = [(f"ein Text von vielen {k % 40} mit Buchstaben {'abcdefghij'[k % 10]}", "de") for k in range(20000)]
    rows += [(f"{k} ?!", "de") for k in range(200)] + [("a text in another language", "en")]
    got = learn(spark.createDataFrame(rows, "text string, lang string"), Limits(texts_per_language=8))
    assert list(got) == ["de", "en"]
    assert got["de"].count(b"ein text von vielen") == 8 and got["en"] == b"a text in another language"


def test_predictions_by_brute_force(spark):
    """Every text against the same dictionaries with a compressor made anew for each piece."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    share = learn(docs.where("text is not null and lang is not null").select("text", "lang"))
    got = {r.doc_id: r for r in identify(docs, share).collect()}
    for doc_id, text, _ in docs.collect():
        data, sizes = normal(text or ""), {}
        for lang, content in share.items():
            total = 0
            for k in range(0, max(len(data), 1), 4096):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                writer = zstandard.ZstdCompressor(level=6, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
                total += len(writer.compress(data[k : k + 4096]))
            sizes[lang] = total
        best, second = sorted(sizes.values())[:2]
        if not any(c.isalpha() for c in text or ""):
            assert got[doc_id].lang_pred == "und"
            continue
        assert sizes[got[doc_id].lang_pred] == best
        assert abs(got[doc_id].score - (1 - best / second)) < 1e-12 and got[doc_id].rejected == (1 - best / second < 0.02)
