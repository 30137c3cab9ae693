"""Registered queries against their SQL or plain Python over whole tables, and the pipeline."""

import re
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from test_ngram_join import brute

import __spark_entry__ as entry
import corpus_pipeline
from merchgrid.llm import decontaminate, language_id, pii

SF = "/root/testdata/sf0.001"


def table(name, *cols):
    return pq.read_table(f"{SF}/{name}.parquet", columns=list(cols)).to_pylist()


@pytest.mark.parametrize("name", ["op3_warc", "op6_exact_dedup"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = entry.oracle_sql()[name]
    assert sorted(c.sql(sql).columns) == cols
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(repr(r) for r in c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())


def test_join_equals_all_pairs(spark):
    want = brute([(r["doc_id"], r["text"]) for r in table("documents", "doc_id", "text")])
    assert {r.doc_id: (r.class_id, r.n_links) for r in entry.queries()["op8_ngram_join"](spark, SF).collect()} == want


def test_leaks_hold_every_passage_that_is_there(spark):
    got = {r.doc_id: set(r.item_ids) for r in entry.queries()["op5_decontaminate"](spark, SF).collect()}
    items = table("benchmark", "item_id", "text")
    for d in table("documents", "doc_id", "text"):
        assert {i["item_id"] for i in items if i["text"] in (d["text"] or "")} <= got[d["doc_id"]]
    assert sum(map(bool, got.values())) < len(got) / 4


def test_pii_digests(spark):
    got = {r.doc_id: r for r in entry.queries()["op9_pii"](spark, SF).collect()}
    for d in table("documents", "doc_id", "text"):
        spans = pii.find(d["text"] or "")
        assert got[d["doc_id"]].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [got[d["doc_id"]][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def test_scores_and_texts(spark):
    lm = entry.queries()["op7_lm_score"](spark, SF).collect()
    assert len(lm) == len(table("documents", "doc_id")) and all(r.score < 0 and r.base_score < 0 for r in lm)
    held = [r for r in lm if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    pages = {r.page_id: r for r in entry.queries()["op4_html_text"](spark, SF).collect()}
    for p in table("pages", "page_id", "html"):
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        assert pages[p["page_id"]].n_chars == len(pages[p["page_id"]].text)
        plain = re.sub(r"\s+", "", re.sub(r"<[^>]+>", "", article).replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&"))
        assert re.sub(r"\s+", "", pages[p["page_id"]].text) == plain


def test_pipeline_against_plain_steps(spark):
    """Every stage on what its predecessor kept, by brute force."""
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in table("documents", "doc_id", "text")}
    docs = {i: t for i, t in docs.items() if any(len(b) for b in language_id.buckets_of(t or ""))}
    seen = {}
    for i in sorted(docs):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]), i)
    docs = {i: docs[i] for i in seen.values()}
    classes = brute(sorted(docs.items()))
    docs = {i: t for i, t in docs.items() if classes[i][0] == i}
    p = decontaminate.index([(r["item_id"], r["text"]) for r in table("benchmark", "item_id", "text")])
    docs = {i: t for i, t in docs.items() if not decontaminate.find(t, p)}
    assert set(out) == set(docs)


def test_stages_keep_columns_and_values(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    clash = ["score", "lang_pred", "leaks", "_sha", "_key", "_id", "row", "rid", "keep_id"]
    text = "The dog and the cat walk into the wood"
    docs = spark.createDataFrame(
        [(i, t, lang, "s", 40, *[f"{c} of {i}" for c in clash]) for i, t, lang in ((1, "Der Hund und die Katze gehen in den Wald", "de"), (2, None, None), (3, text, "en"), (3, text, "en"), (4, text + " and run. " * 300_000, None))],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r.doc_id for r in rows} >= {1, 3, 4}, name
        for r in rows:
            assert [r[c] for c in clash] == [f"{c} of {r.doc_id}" for c in clash], name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
