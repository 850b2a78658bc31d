from collections import defaultdict

import duckdb

from evidentia.llm.catalog import OP9_SQL, op9_chat_format
from evidentia.llm.chat import rotate

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", "hello <|im_end|> there"), (1, 3, "ann", None), (1, 3, "ann", None),
    (2, 0, "system", "alone"), (3, 0, None, "who"), (None, 5, "ann", "lost"), (None, None, "bob", "no number"), (4, 10, "a", ""), (4, 9, "b", "first"),
    (5, 0, "x", "t " * 20000), (5, 64, "y", "next part"), (5, 63, "x", "end of part"),
]


def brute(rows, step=1024):
    """Whole renderings, and then their pieces of ``step`` turns."""
    groups = defaultdict(list)
    clean = lambda t: (t or "").replace("<|", "< |")
    for conv, turn, role, text in rows:
        groups[conv].append((turn if turn is not None else -1, clean(role if role is not None else "unknown"), clean(text)))
    out = []
    for conv, messages in groups.items():
        for speaker in {m[1] for m in messages} - {"system"}:
            at, turns = 0, []
            for _, role, body in sorted(messages):
                name = "assistant" if role == speaker else "system" if role == "system" else f"user name={role}"
                head = f"<|im_start|>{name}\n"
                text = f"{head}{body}<|im_end|>\n"
                turns.append((text, f"{at + len(head)}:{at + len(text) - 1}" if role == speaker else None))
                at += len(text)
            for k in range(0, len(turns), step):
                part = turns[k : k + step]
                spans = [s for _, s in part if s]
                out.append((conv, speaker, k // step, len(part), len(spans), "".join(t for t, _ in part), ",".join(spans)))
    return sorted(out, key=repr)


def test_like_brute_force(spark):
    df = spark.createDataFrame([(c, t, r, x, 1, "s") for c, t, r, x in ROWS], "conv_id long, turn long, role string, text string, piece int, speaker string")
    assert sorted(map(tuple, rotate(df).collect()), key=repr) == brute(ROWS)
    assert sorted(map(tuple, rotate(df, piece_turns=2).collect()), key=repr) == brute(ROWS, 2)
    assert rotate(df.limit(0)).count() == 0


def test_masks_hold_the_speakers_words(spark):
    chats = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = rotate(chats).collect()
    own = defaultdict(list)
    for r in chats.orderBy("turn").collect():
        own[r.conv_id, r.role].append(r.text)
    assert {(r.conv_id, r.speaker) for r in got} == {k for k in own if k[1] != "system"}
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r.masks.split(",")]
        assert [r.text[a:b] for a, b in spans] == [t + "<|im_end|>" for t in own[r.conv_id, r.speaker]]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_crowded_turn_under_other_partitionings(spark):
    """5000 rows on one turn number, some of them repeated, and as many without a number."""
    rows = [(7, 3, f"r{i % 3}", f"text {i * 7919 % 4001}") for i in range(5000)] + [(None, None, "a", f"{i % 50}") for i in range(2500)]
    rows += [(7, 0, "system", "be kind"), (7, 900, "r0", "far"), (8, None, "system", "no number"), (8, 1, "r1", "hi")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for frame in (df, df.repartition(1), df.repartition(7, "text")):
        got = rotate(frame).collect()
        assert sorted(map(tuple, got), key=repr) == want and max(r.n_turns for r in got) <= 1024
    assert max(r[2] for r in want) == 4


def test_pieces_are_one_whole_dialogue(spark):
    rows = [(1, i, "system" if not i else f"p{i % 2}", f"turn {i}") for i in range(200)] + [(1, None, "p0", "first of all")]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.speaker: r for r in rotate(df).collect()}
    assert len(whole) == 2 and sorted(map(tuple, whole.values()), key=repr) == brute(rows)
    pieces = rotate(df, piece_turns=7).orderBy("piece").collect()
    for speaker, r in whole.items():
        own = [p for p in pieces if p.speaker == speaker]
        assert "".join(p.text for p in own) == r.text and ",".join(p.masks for p in own if p.masks) == r.masks
        spans = [tuple(map(int, s.split(":"))) for s in r.masks.split(",")]
        assert all(r.text[b - 10 : b] == "<|im_end|>" for _, b in spans)


def test_query_like_its_sql_on_crowded_conversations(spark, tmp_path):
    rows = ROWS + [(7, 3 if i % 5 else None, f"r{i % 3}", f"text {i * 7919 % 401}") for i in range(3000)] + [(7, 0, "system", "s"), (7, 99, "r1", "later")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op9_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(OP9_SQL)
    names = [c[0] for c in cursor.description]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
