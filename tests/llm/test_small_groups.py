"""Small and rare groups get the whole job as well."""

import numpy as np
import pytest
from conftest import SMALL, same

from galewatch.llm import components, line_dedup, pii, vector_dedup


def test_lines_of_small_hosts(spark):
    rows = [("h19", f"menu\nown {i}") for i in range(19)] + [("h2", "nav\nx"), ("h2", " nav \ny"), ("h1", "alone\nalone"), (None, "foot\np"), (None, "foot\nq"), (None, "r")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, site string, text string")
    got = {r["id"]: (r["text"], r["_n_dropped"]) for r in line_dedup.drop_lines(df, "site", "text").collect()}
    want = [(f"own {i}", 1) for i in range(19)] + [("x", 1), ("y", 1), ("alone\nalone", 0), ("p", 1), ("q", 1), ("r", 0)]
    assert [got[i] for i in range(len(rows))] == want


def test_line_query_over_all_hosts(spark):
    assert same(spark, SMALL, line_dedup.op5_line_dedup, line_dedup.ORACLE) > 0


def test_lines_of_a_small_source_in_the_pipeline(spark):
    import corpus_pipeline as pipeline

    rows = [(i, f"notice\nown {i}", "en", "small", 9) for i in range(5)] + [(9, "same", "en", "tiny", 4), (10, "same", "en", "tiny", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in pipeline.boilerplate_lines(spark, docs, SMALL).collect()}
    assert got == {i: f"own {i}" for i in range(5)} | {9: "same", 10: "same"}


class Blind:
    """A graph that finds nothing but a query's own node until its beam is a scan."""

    def __init__(self, x, own):
        self.x, self.own = x, own

    def within(self, q, least, width):
        hit = q @ self.x.T.astype(np.float32) >= least
        if 4 * width < len(self.x):
            hit &= self.own & (q @ self.x.T.astype(np.float32) >= 1 - 1e-6)
        return np.nonzero(hit)


@pytest.mark.parametrize("own,links", [(True, 2), (True, 400), (False, 2), (False, 400)])
def test_audit_of_sparse_links(own, links):
    rng = np.random.default_rng(links)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(2000, 48)))
    y = unit(rng.normal(size=(2000, 48)))
    at = rng.choice(1000, links, replace=False)
    if own:
        y = x
        x[at + 1000] = unit(x[at] + 0.01 * rng.normal(size=(links, 48)))
    else:
        x[at] = unit(y[at + 1000] + 0.01 * rng.normal(size=(links, 48)))
    got = set(zip(*map(np.ndarray.tolist, vector_dedup.pairs_within(Blind(y, own), x, y, 0.93)[:2])))
    assert {p for p in got if not own or p[0] != p[1]} == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(x @ y.T >= 0.93))) if not own or a != b}
    assert len(got) >= links


def test_rare_kind_beside_many_addresses(spark):
    ips = [(i, " x ".join(f"{999 if k % 2 else 10}.{i % 250}.{k}.1" for k in range(20))) for i in range(1000)]
    mails = [(2000 + i, f"mail to ann{i}@mail{i % 7}.example.org now") for i in range(150)]
    loose = [(3000 + i, f"mail to bob{i} [at] mail{i % 7} [dot] example [dot] org now") for i in range(20)]
    docs = spark.createDataFrame(ips + mails + loose, "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_pii(docs).where("doc_id >= 2000").collect()}
    assert got == {d: ["email"] for d in got} and len(got) == 170


def test_signature_of_many_edges(spark):
    n, total = components._signature(spark.range(1 << 25).selectExpr("id u", "id + 1 v"))
    assert n == 1 << 25 and total > 1 << 63
    assert components._signature(spark.createDataFrame([], "u long, v long")) == (0, 0)
