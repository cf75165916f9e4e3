"""Ids that no double holds beside null ones; broken pages and texts full of secrets, in time that grows with them."""

import hashlib
import random
import re
import time

import pytest

from millrace.llm import decontaminate, fingerprints, html_extract, langid, packing, secrets, suffix_dedup, urlfilter

SF = "/root/testdata/sf0.001"
BIG = [2**60 + 1, 2**60 + 2, None, 2**53 + 1, -(2**62) - 1, None]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    some = [" ".join(rng.choice(["mill", "race", "stone", "wheel", "water", "flour", "grain"]) + str(rng.randrange(50)) for _ in range(120)) for _ in range(3)]
    rows = [(d, some[i % 3], "en", None if d is None else d + 1, None if i % 2 else i) for i, d in enumerate(BIG)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, small int").coalesce(1)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(d, "http://mail.example.com/en/7", f"<html><body>{'<article>' if i % 2 else '<div>'}<p>Some words of page {i}</p></body></html>") for i, d in enumerate(BIG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x or 0))


WANT = sorted(BIG, key=lambda x: (x is None, x or 0))


def test_ids_stay(spark, docs, pages):
    items = docs.limit(3).selectExpr("coalesce(doc_id, 7) as item_id", "text")
    hits = decontaminate.contamination(docs, items)
    assert set(ids(hits)) == set(WANT)
    assert {r.item_id for r in hits.collect()} == {BIG[0], BIG[1], 7}
    assert set(ids(decontaminate.contamination(docs, items, max_sketch=0))) == set(WANT)
    assert ids(packing.pack(docs)) == WANT
    assert ids(fingerprints.fingerprints(docs)) == WANT
    assert ids(fingerprints.compare_edits(docs)) == WANT
    assert ids(langid.identify(docs)) == WANT
    assert ids(suffix_dedup.remove_repeats(docs, length=100)) == WANT
    assert ids(html_extract.extract(pages), "page_id") == WANT
    assert ids(urlfilter.judge_urls(pages), "page_id") == WANT
    assert ids(urlfilter.judge_urls(pages, max_bits=60), "page_id") == WANT


def test_language_keeps_all_columns(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.language(spark, docs, SF)
    assert out.schema == docs.schema
    key = lambda r: repr(tuple(r))
    assert sorted(out.collect(), key=key) == sorted(docs.collect(), key=key)


def test_repeated_rows_are_dealt_to_all_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "BIN_ROWS", 20)
    out = packing.pack(spark.createDataFrame([(None, "")] * 300, "doc_id long, text string")).toPandas()
    assert len(out) == 300
    assert (out.sequence_id // 2**32).nunique() >= 10
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a b="' * 170_000, "<" * 1_000_000, "<!--" + "<b" * 500_000, "<div>" * 200_000, "</p>" * 250_000, "<a b='\"" * 150_000])
def test_broken_pages_take_linear_time(page):
    at = time.process_time()
    html_extract.blocks(page)
    assert time.process_time() - at < 8


def base_spans(text):
    """As the contract has it, by re."""
    kinds = [("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = [(m.start(), i, k, m.end()) for i, (k, p, g, least) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found)), [sum(k == x[2] for x in found) for k, *_ in kinds]


def test_base_spans_of_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    out = secrets.digest(secrets.find_secrets(table)).collect()
    assert len(out) == len(texts)
    for r in out:
        spans, n = base_spans(texts[r.doc_id])
        assert (r.base_sha256, [r.n_assign, r.n_access, r.n_hex]) == (hashlib.sha256(spans.encode()).hexdigest(), n)


def test_many_matches_in_a_text(spark):
    rng = random.Random(3)
    text = " ".join(f"é token={rng.randrange(10**9, 10**10)}" for _ in range(30_000))
    table = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    secrets.digest(secrets.find_secrets(table.limit(0))).collect()
    at = time.monotonic()
    row = secrets.digest(secrets.find_secrets(table)).first()
    assert time.monotonic() - at < 30  # a quadratic one takes minutes beside the start of its jobs
    spans, n = base_spans(text)
    assert (row.base_sha256, row.n_assign) == (hashlib.sha256(spans.encode()).hexdigest(), n[0])
    assert secrets.redact(table, mark="*").first().text == re.sub(r"token=\d+", "*", text)
