import re
from collections import Counter
from itertools import permutations

from evidentia.llm.interaction import filter_audit, orders, step_counts

LONG = " ".join(f"w{i}" for i in range(30000))
DUP = "same words again and again " * 12
ROWS = [
    (1, LONG, "a"), (2, "Short.", "a"), (3, None, "a"), (4, "", None), (5, "Short.", ""), (6, DUP, "b"), (7, DUP, "b"), (7, DUP, "b"),
    (8, "LOUD " * 60, "b"), (9, " ".join(f"x{i}#" for i in range(60)), "a"), (None, "Short.", "c"), (None, DUP, "c"), (10, "é " * 70, "c"), (11, LONG, "a"),
    (12, "\t\n ", "é"), (13, " ".join(f"v{i}" for i in range(50)), "é"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, 1), (7, 0, 1), (8, None, None), (None, 1, 1), (99, 1, 1), (11, 1, None)]


def brute(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    facts = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        facts.append((part or "", fails, i in good, i in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in facts}:
            for step in range(1, 6):
                out[part, order, step] = Counter()
        for part, fails, g, x in facts:
            gone = next((k for k, c in enumerate(order, 1) if fails[c]), 6)
            for step, c in enumerate(order, 1):
                n = out[part, order, step]
                n["kept"] += gone > step
                n["removed"] += gone == step
                n["redundant"] += fails[c] and gone < step
                n["unique_fails"] += fails[c] and sum(fails.values()) == 1
                n["good_lost"] += gone == step and g
                n["toxic_lost"] += gone == step and x
    total = Counter()
    for (part, order, step), n in out.items():
        total[part, order[step - 1]] += n["removed"]
    return {(p, o, s): (n["kept"], n["removed"], n["redundant"], n["unique_fails"], n["good_lost"], n["toxic_lost"], total[p, o[s - 1]]) for (p, o, s), n in out.items()}


def test_audit_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, s, True, 1, "x", 9) for i, t, s in ROWS], "doc_id long, text string, source string, good boolean, mask int, part string, quality int")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    got = filter_audit(docs, labels).collect()
    assert len(got) == 600 * len({s or "" for _, _, s in ROWS})
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute(ROWS, LABELS)


def test_orders_and_empty_tables(spark):
    assert orders(spark).select("filter_order").distinct().count() == 120
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "Short.", "a")], "doc_id long, text string, source string")
    assert {(r.step, r.letter): r.removed for r in filter_audit(some, labels).selectExpr("step", "substr(filter_order, step, 1) as letter", "removed", "filter_order").where("filter_order = 'BACDE'").collect()}[2, "A"] == 1


def test_documents_are_not_shuffled_for_the_replay(spark, capsys):
    step_counts(spark.createDataFrame([("a", 1, True, False)], "part string, mask int, good boolean, toxic boolean")).explain()
    plan = capsys.readouterr().out
    assert "partial_count" in plan and "BroadcastNestedLoopJoin" in plan and "Python" not in plan and "Arrow" not in plan
