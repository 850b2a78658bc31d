import random
import re
from collections import Counter

from evidentia.llm.rules import POLICIES, RULES, Policy, ablations, apply_policies, ledger, mask_of, quality_rules

random.seed(5)
ROWS = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, "one two three one two three"), (5, "a a a a"), (6, "x\ny\nx\n\nx \r\nx"), (7, "é … # | ** a1 é"),
    (None, "one"), (8, "LOUD " * 60), (8, "LOUD " * 60), (9, "- bullet one\n* bullet two\n• bullet three\nplain..."), (10, "cut off ...\nand again…\nend"),
    (11, " ".join(random.choice("abcdefg") for _ in range(300))), (12, " ".join(f"w{i % 5000}" for i in range(30000))), (13, " ".join(f"v{i}" for i in range(40000))),
    (14, "a b c x a b c"), (15, "ab c d e ab c d e"), (16, "x" * 50000), (17, " ".join(f"fine{i}" for i in range(60))), (18, "a  b c a b  c"),
]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    m = dict(
        n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", t)), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(repeated),
        n_lines=len(lines), n_bare_words=sum(not re.search(r"[A-Za-z0-9\x80-\U0010ffff]", x) for x in w), n_capitals=len(re.findall("[A-Z]", t)),
        n_bullet_lines=sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in lines), n_cut_lines=sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines),
    )
    fails = [
        m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], not 2 * m["n_words"] <= m["word_chars"] <= 12 * m["n_words"], 10 * m["n_symbols"] > m["n_words"],
        10 * m["n_dup_lines"] > 3 * m["n_lines"], 5 * m["n_bare_words"] > m["n_words"], 10 * m["n_capitals"] > 3 * m["word_chars"], 10 * m["n_bullet_lines"] > 9 * m["n_lines"],
        10 * m["n_cut_lines"] > 3 * m["n_lines"],
    ]
    return m, fails


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", None) for i, t in rows], "doc_id long, text string, bits int, lines string, words string")


def test_rules_by_brute_force(spark):
    got = quality_rules(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    texts = {}
    for i, t in ROWS:
        texts.setdefault(i, t)
    for r in got:
        m, fails = brute(texts[r.doc_id])
        assert {k: r[k] for k in m} == m, r.doc_id
        assert r.bits == sum(1 << k for k, f in enumerate(fails) if f)
        assert r.base_failed == (fails[0] or fails[1])
        assert r.kept == r.kept_general_2 == (not any(fails[k] for k in (0, 1, 3, 5, 6)) and sum(fails[k] for k in (2, 4, 7, 8)) <= 1)
        assert r.kept_general_1 == (not any(fails[:7])) and r.kept_base_1 == (not any(fails[:2]))
    assert {r.doc_id for r in got if r.kept} == {13, 17}


def test_policies_and_ablations(spark):
    policies = (*POLICIES, Policy("lenient", 1, ("few_words",), ("symbols", "capitals", "bare_words"), 2))
    entries = ledger(frame(spark, ROWS))
    assert [p.name for p in policies] == [c.split("_")[1] for c in apply_policies(entries, policies).columns if c.startswith("kept_")]
    known = [r.name for r in RULES]
    bits = [r.bits for r in entries.collect()]

    def kept(b, p):
        return not b & mask_of(p.hard) and (b & mask_of(p.soft)).bit_count() <= p.allowed

    got = {(r.policy, r.version, r.rule): r for r in ablations(entries, policies).collect()}
    assert len(got) == sum(len(p.hard) + len(p.soft) for p in policies)
    for p in policies:
        for name in (*p.hard, *p.soft):
            r, bit = got[p.name, p.version, name], 1 << known.index(name)
            without = [b for b in bits if kept(b & ~bit, p)]
            only = [b for b in without if not kept(b, p)]
            beside = 0
            for b in only:
                beside |= b
            assert (r.rows, r.failing, r.kept, r.kept_without, r.only_here, r.failing_beside) == (
                len(bits), sum(bool(b & bit) for b in bits), sum(kept(b, p) for b in bits), len(without), len(only), beside)


def test_empty_and_native(spark, capsys):
    assert quality_rules(frame(spark, [])).count() == 0
    from evidentia.llm.rules import measured

    measured(frame(spark, ROWS)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
