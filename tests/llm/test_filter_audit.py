"""The audit of filters against its SQL and against filters that are applied one after the other."""

import re
from itertools import permutations

from conftest import SMALL, same

from galewatch.llm import filter_audit


def test_equals_sql(spark):
    assert same(spark, SMALL, filter_audit.op13_filter_audit, filter_audit.ORACLE) % 600 == 0


def brute(rows, labels):
    """doc_id, text, source rows -> {(part, order, step): counts}, filter by filter."""
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        tags = [(q, t) for j, q, t in labels if i is not None and j == i]
        docs.append((source or "", fails, any(q == 1 for q, _ in tags), any(t == 1 for _, t in tags)))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                failing = [d for d in docs if d[0] == part and d[1][f]]
                removed = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(removed)
                alone = sum(1 for d in failing if sum(d[1].values()) == 1)
                out[part, order, step] = [len(left), len(removed), len(failing) - len(removed), alone, sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_equals_filters_in_turn(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, None), (2, "", ""), (3, plain, "a"), (4, plain, "a"), (4, plain, "a"), (None, plain, "b"), (None, plain, "b"), (5, "LOUD " * 60, "a"), (6, "loud # " * 40, "a"), (7, plain + " #", "a")]
    rows += [(8, plain + " É" * 40, "b"), (9, "x" * 300_000 + " $", None), (10, "A\x0bB\tC\n" * 3, "b"), (11, plain, "b"), (12, None, "b"), (0, "one two " * 60, "c")]
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (5, 0, 1), (None, 1, 1), (7, 1, 1), (6, None, None), (99, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, 1, True) for i, t, s in rows], "doc_id int, text string, source string, part int, digest boolean")
    tags = spark.createDataFrame(labels, "doc_id int, quality int, toxic int")
    got = filter_audit.audit(docs, tags).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute(rows, labels) and len(got) == 4 * 600
    assert filter_audit.audit(docs.where("false"), tags).count() == 0
    assert filter_audit.audit(docs, tags.where("false")).agg({"good_lost": "sum"}).first()[0] == 0
