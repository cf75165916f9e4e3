"""The ten operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, fingerprints, html_extract, jaccard_join, langid, packing, quotes, secrets, suffix_dedup, urlfilter

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies about the threshold, a hot passage, nulls, empties; more columns with names the operators use."""
    rng = random.Random(4)
    base, hot, rows = words(rng, 60).split(), words(rng, 30), []
    for i in range(90):
        if i % 9 == 0:
            text = [None, "", " \n", "ab"][i // 9 % 4]
        elif i % 3 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(60)] = "zz"
            text = " ".join(w)
        elif i % 3 == 1:
            text = words(rng, 40) + " " + hot
        else:
            text = rng.choice(["Same text, TWICE over: token = abcdef123456 and more words here é", words(rng, 5)])
        rows.append((i, text, "en", f"s{i % 4}", i, i))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, row long").repartition(3)


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("small", "leaders"), [(256, 16), (3, 1)])
def test_jaccard(docs, monkeypatch, small, leaders):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 1_000_000 if small > 3 else 0)
    sets = {d: shingles(t) for d, t in texts(docs).items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard_of_rows(spark):
    """Rows of null or equal ids are documents of their own; the pipeline keeps one row of each component."""
    import corpus_pipeline

    rng = random.Random(7)
    a, b, c, d, e = (words(rng, 40) for _ in range(5))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (3, d), (0, d + " zz"), (4, e), (None, e), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs).collect()]
    want = [(1, 36, 1)] * 2 + [(None, 36, 1), (None, 36, None), (None, 36, None), (2, 36, 2), (2, 36, 0), (3, 36, 0), (0, 37, 0), (4, 36, 4), (None, 36, 4), (5, 0, 5), (None, 0, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (None, b), (2, c), (0, d + " zz"), (4, e), (5, None), (None, "")]))


def test_decontamination_of_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    item, clean = words(rng, 20), words(rng, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {item} y"), (None, clean), (1, item), (1, clean), (2, clean), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, clean), (1, clean), (2, clean), (3, None)]))


@pytest.mark.parametrize("length", [25, 60])
def test_suffix_dedup(docs, length):
    data = {d: t.encode() for d, t in texts(docs).items()}
    seen = {}
    for t in data.values():
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    want = {}
    for d, t in data.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want[d] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    rows = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length=length)).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == want
    assert all(r.n_kept == r.n_bytes - r.n_removed == len(r.text.encode()) for r in rows)  # cuts of these texts are between characters


@pytest.mark.parametrize("q", [2, 3, 5, 7, 17])
def test_difference_cover(q):
    v, d = suffix_dedup.difference_cover(q)
    assert len(d) == q + 1
    assert {(int(a) - int(b)) % v for a in d for b in d} == set(range(v))


def test_secrets(spark):
    live, copied = "ghp_" + "aB3" * 12, "ghp_" + "xY9" * 12
    rows = [(1, f"é password: 'hunter22' {live}", "a"), (2, f"{copied} AKIA{'Q7' * 8}", "a"), (3, f"x {copied}", "b"), (4, None, None), (5, "token: token = abcdefgh", "c"), (6, "deadbeef" * 3, None)]
    got = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[1].spans == "assign:2:21,github:23:63"
    assert (got[2].spans, got[3].spans) == ("access:41:61", "")
    assert (got[4].spans, got[5].spans, got[6].n_hex) == ("", "", 1)
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert clean[1] == "é [SECRET]' [SECRET]"
    assert clean[4] is None


def test_secrets_copied_by_few_stay_live(spark):
    """20 owners: a token in copies of one text everywhere, one quoted by two others, one of a busy owner, and an example that half hold."""
    copy, quoted, busy, example = ("ghp_" + x * 12 for x in ("aB3", "xY9", "Qr5", "mN7"))
    rows = [(f"the same page with {copy} in it", f"s{i}") for i in range(20)]
    rows += [(f"text {i} has {quoted}", f"s{i}") for i in range(3)] + [(f"own text {i} of {busy}", "s4") for i in range(30)] + [(f"example {i}: {example}", f"s{i}") for i in range(10)]
    rows += [(f"single AKIA{i:04d}{'Q7' * 8}", f"s{i}") for i in range(20)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    for r in secrets.redact(docs).collect():
        assert ("ghp_" in r.text) == ("example" in r.text), r.text
    few = docs.where(F.col("text").contains("example") | F.col("text").contains("own text"))
    assert {r.n_live for r in secrets.find_secrets(few).collect()} == {1}  # many owners, but no more repositories than one owner's value has


def test_redaction_by_row(spark):
    rows = [(None, "password: hunter22", "a"), (None, "a long and clean text without any", "a"), (None, "x token=abcdef123", "b"), (None, None, "b"), (7, "AKIA" + "Q7" * 8, "a"), (7, "clean text of the same number", "b"), (7, "see secret: 'swordfish' there", "c"), (8, "token=abcdef123", "a"), (8, "token=abcdef123", "a")]
    clean = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = [(None, "[SECRET]"), (None, "a long and clean text without any"), (None, "x [SECRET]"), (None, None), (7, "[SECRET]"), (7, "clean text of the same number"), (7, "see [SECRET]' there"), (8, "[SECRET]"), (8, "[SECRET]")]
    assert sorted((str(r.doc_id), str(r.text)) for r in clean) == sorted((str(d), str(t)) for d, t in want)


@pytest.mark.parametrize(("limit", "pairs"), [(4_000_000, 1_000_000), (4_000_000, 3), (-1, 3)])
def test_decontamination(spark, docs, monkeypatch, limit, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    held = texts(docs)
    items = [(1, held[1][-80:]), (2, "no such words in any of them at all"), (3, None), (4, held[3]), (4, held[3])]
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), max_sketch=limit).collect())
    want = sorted((d, i, len(shingles(t or "") & shingles(x)), len(shingles(t or ""))) for i, t in items for d, x in held.items() if shingles(t or "") and 100 * len(shingles(t or "") & shingles(x)) >= 75 * len(shingles(t or "")))
    assert got == want
    assert any(i == 1 for _, i, *_ in got)


def test_packing(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, window=16, keep_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    for d, t in texts(docs).items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(rows[rows.doc_id == d].sort_values("start").ids) == ids
    by = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 16).all()
    assert all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    hard = ["Σίσυφος ΟΔΟΣ. İstanbul", "don't I'LL a's's", "a.b,c... x!? 3.14", "Ⅷ ① ǅ ẞ", "<|endoftext|>abc", "\x1c\x1da b\x85c", "ſecret K ﬁ"]
    assert packing.encoder(packing.vocabulary()).texts(hard) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(hard, add_special_tokens=False)]


def test_best_fit_is_best_fit():
    rng = random.Random(2)
    lengths = np.array(sorted((rng.randint(1, 30) for _ in range(200)), reverse=True))
    rooms, want = [], []
    for n in lengths.tolist():
        fits = [r for r in rooms if r >= n]
        want.append(min(fits) if fits else 32)
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 32) - n)
    seq, offset = packing.best_fit(lengths, 32)
    assert [32 - o for o in offset.tolist()] == want


def test_fingerprints(docs):
    held = texts(docs)
    order = sorted(held, reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    for i, d in enumerate(order):
        t, following = held[d], held[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1
    assert len({r.fingerprint for r in got.values() if held[r.doc_id] == held[4] or r.doc_id == 4}) == 1
    for one_in in (1, 2, 64):  # of a union: the merged sketches of its parts
        x, y, both = (fingerprints.written(f, one_in) for f in fingerprints.sketches([held[1].encode(), held[4].encode(), (held[1] + "\n").encode()], one_in))
        union = sorted({*fingerprints.sketches([held[1].encode()], 1)[0].tolist(), *fingerprints.sketches([held[4].encode()], 1)[0].tolist()})
        want = [h for h in union if h <= fingerprints.limit(one_in)] or union[:1]
        assert fingerprints.read(fingerprints.merge(x, y)).tolist() == want
        assert x == both
    with pytest.raises(ValueError):
        fingerprints.merge("s2:", "s4:")
    x, y = fingerprints.sketches([held[1].encode(), " ".join([held[1], "and", held[4]]).encode()], 1)
    assert fingerprints.containment(x, y) == 1.0
    assert fingerprints.containment(y, x) == len(x) / len(y)
    x, y = (fingerprints.sketches([held[1].encode(), held[4].encode()], 1))
    assert fingerprints.likeness(x, y) == len(shingles(held[1]) & shingles(held[4])) / len(shingles(held[1]) | shingles(held[4]))


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/7x?y", "https://b.com/en/1", "http://example.net/de/81", "x.net/de/", None, "http://spam-farm.example.org/fr/", "http://sub.ads-track.example.com#f", "http://ok.org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [("allow", "example.com/en/7"), ("block", "com/en/"), ("block", "example.net/de/8"), ("allow", None), ("allow", None), ("block", None), ("block", None), ("block", "org/es/")]
    table = spark.createDataFrame([(x, 1) for x in (*urlfilter.LISTED, None, "")], "domain string, key int")
    for how in ({}, {"max_bits": 64}, {"listed": table, "rate": 0.4}):  # one cascade, several, a table of hosts
        assert [(r.verdict, r.rule) for r in urlfilter.judge_urls(df, **how).orderBy("page_id").collect()] == want


def test_url_filter_of_many_hosts(spark):
    """A list and urls of thousands of hosts, against sets, by cascades of several levels and shards; extra columns clash."""
    rng = random.Random(9)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "d1", "www", "e"]) for _ in range(rng.randint(1, 4))) + rng.choice([".com", ".net"])
    bad = sorted({host() for _ in range(600)})
    urls = [f"http://{host()}/{rng.choice(['', 'en/', 'en/7'])}" for _ in range(3000)]
    df = spark.createDataFrame([(i, u, "x", "y", ["z"]) for i, u in enumerate(urls)], "page_id long, url string, host string, key string, hits array<string>").repartition(3)
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(df, rules=(), listed=spark.createDataFrame([(b,) for b in bad], "h string"), rate=0.3, max_bits=512).collect()}
    for i, u in enumerate(urls):
        parts = u[7:].split("/")[0].split(".")
        assert got[i] == ("block" if any(".".join(parts[j:]) in bad for j in range(len(parts))) else "allow"), u


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = urlfilter.cascade(universe, universe.where("key like '%7'"), rate=0.3)
    assert len(levels) > 1
    assert all(urlfilter.listed_by(levels, f"k{i}") == (i % 10 == 7) for i in range(3000))


def test_language_id(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10_000, None, "en"), (10_001, "123 !?", "en"), (10_002, "a", None)], "doc_id long, text string, lang string")
    rows = langid.identify(d.select("doc_id", "text", "lang").union(more)).join(d.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (10_000, 10_001)} == {10_000: "und", 10_001: "und"}
    assert sum(r.rejected for r in rows) <= 3


@pytest.mark.parametrize("size", [20, 200])
def test_language_id_rejects(spark, size):
    """Limits come from all training rows, whatever their ids: other languages are rejected, held-out rows aren't."""
    given = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 100").select("doc_id", "text", "lang").orderBy("doc_id").limit(size)
    rows = given.where(~langid.held_out())
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    ]
    model = langid.fit(rows)
    assert np.isfinite(model.limits).all()
    assert [r.rejected for r in langid.predict(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model).collect()] == [True] * 3
    assert langid.predict(given, model).where("rejected").count() <= size // 100
    # no row of this table has an id that a sample by id would take
    ids = [i for i in range(100_000) if i % 128 == 77][: rows.count()]
    again = langid.fit(spark.createDataFrame([(i, r.text, r.lang) for i, r in zip(ids, rows.collect())], "doc_id long, text string, lang string"))
    assert (again.limits == model.limits).all()


@pytest.mark.parametrize("cells", [1_000_000, 4000])
def test_language_id_in_tables(spark, monkeypatch, cells):
    """A model beyond max_cells says what the one in memory says: no n-gram is left out, and a text may span blocks."""
    monkeypatch.setattr(langid, "BLOCK_CELLS", cells)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("n"), F.lit(2).alias("_row"))
    more = [(2**60 + 1, "Все люди рождаются 𝔘𝔫𝔦 свободными", "ru", 1, 2), (None, None, "en", 1, 2), (7, "12 !", "en", 1, 2), (8, "a", None, 1, 2), (8, "a", None, 1, 2), (9, "日本語", None, 1, 2)]
    d = d.union(spark.createDataFrame(more, "doc_id long, text string, lang string, n int, _row int"))
    rows = d.where(~langid.held_out())
    small, large = langid.fit(rows), langid.fit(rows, max_cells=10)
    assert isinstance(small, langid.Model)
    assert isinstance(large, langid.Spread)
    assert large.langs == small.langs
    assert large.limits == pytest.approx(small.limits, abs=0.01)
    assert large.sharpness == pytest.approx(small.sharpness, rel=0.05)
    large.sharpness = small.sharpness  # steps of the middle may fall apart by one
    want, got = (sorted(langid.predict(d, m).collect(), key=lambda r: (str(r.doc_id), str(r.text))) for m in (small, large))
    assert len(got) == d.count()
    for a, b in zip(want, got, strict=True):
        assert a[:6] == b[:6]
        assert (a.rejected, b.score, b.bits) == (b.rejected, pytest.approx(a.score, abs=1e-3), pytest.approx(a.bits, abs=1e-3))


def test_kneser_ney_sums_to_one():
    import pandas as pd

    g, n = np.unique(langid.grams(langid.letters("the cat that sat on the hat"), langid.ORDER), return_counts=True)
    m = langid.model_of(pd.DataFrame({"lang": "en", "gram": g.view(np.int64), "n": n}))
    alphabet = sorted(set(langid.letters("the cat that sat on the hat").tolist()))
    context = langid.letters("the")[:3].tolist()
    bits = [m.bits(np.array([*context, c], np.uint64), np.zeros(4, np.int64), 1)[0, 0] for c in alphabet]
    unseen = m.bits(np.array([*context, 0x7A7A], np.uint64), np.zeros(4, np.int64), 1)[0, 0]
    assert sum(2.0**-b for b in bits) + 2.0**-unseen == pytest.approx(1, abs=0.02)


def test_html(spark):
    foot = "all rights reserved by the owners of this very site since nineteen ninety nine"
    article = "<html><head><title>no</title></head><body><nav>menu</nav><article><header><h1>T &amp; t</h1></header><p>one<br>two<p>three<script>'</p>'</script><div class='comments'>no</div></article><footer>no</footer></body>"
    plain = [f"<body><div><p>{a}</p></div><div>{foot}</div></body>" for a in ("alpha beta gamma", "delta epsilon zeta", "third")]
    rows = [(0, "http://h.com/1", article), *((i + 1, "http://h.com/x", p) for i, p in enumerate(plain)), (9, None, None), (10, "http://h.com/2", "")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "T & t\n\none two\n\nthree", 1: "alpha beta gamma", 2: "delta epsilon zeta", 3: "third", 9: "", 10: ""}


def test_html_where_markup_says_nothing(spark):
    """Boilerplate that no tag or class betrays goes by the host's suffix array; passages that articles share stay."""
    rng = random.Random(11)
    top, side, foot, shared = (words(rng, n) for n in (20, 30, 25, 40))
    rows, want = [], {}
    for i in range(40):
        own = [words(rng, rng.randint(5, 60)) for _ in range(3)]
        body = [top, own[0], shared if i % 5 == 0 else own[1], side, own[2], foot]
        if i % 2:  # divisions only
            html_ = "<body>" + "".join(f"<div>{x}</div>" for x in body) + "</body>"
            want[i] = "\n\n".join(x for x in body if x in own)
        else:  # an article; within it a block of links that may mean either, and one that is its own
            html_ = f"<body><div>{top}</div><article class='post tag-menu'><h1 id='cookie-recipes'>{own[0]}</h1><p>{shared}</p><section class='related-work'>{own[1]}</section><div class='share'>{side}</div><math><mi>E</mi></math> is</article><div class='social'>{own[2]}</div></body>"
            want[i] = "\n\n".join([own[0], shared, own[1], "E is"])
        rows.append((i, f"http://{'hot' if i < 30 else 'cold'}.example.com/{i}", html_, "text", "host"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    odd = {i for i in range(40) if i % 10 == 5}  # shared by pages without an article: repeated, so not their own
    assert {i: got[i] for i in want if i not in odd} == {i: want[i] for i in want if i not in odd}
    assert {i for i in odd if shared in got[i]} == {35}  # the only one of its host


@pytest.mark.parametrize(("suffixes", "wanted"), [(500_000, 1_000_000), (100, 0)])
def test_html_boilerplate_in_articles(spark, monkeypatch, suffixes, wanted):
    """What most articles of a host have goes, though its markup is an article's own; what fewer share, copies and small hosts stay."""
    monkeypatch.setattr(html_extract, "SUFFIXES", suffixes)
    monkeypatch.setattr(html_extract, "WANTED", wanted)
    rng = random.Random(8)
    plug, tail, shared, one = (words(rng, n) for n in (15, 14, 30, 100))
    rows, want = [], {}

    def page(host, kept, *more, around="<article>%s</article>"):
        i = len(rows)
        rows.append((i, f"http://{host}.com/{i}" if host else None, "<nav>menu</nav>" + around % "".join(f"<p>{x}</p>" for x in (*kept[:1], *more, *kept[1:]))))
        want[i] = "\n\n".join(kept)

    for i in range(24):
        own = [words(rng, 40), *([shared] if i < 9 else []), words(rng, 50) + (f" {plug[:20]}" if i == 3 else "")]
        if i == 7:  # a page that is little but what all have: a copy, or no article to speak of
            page("hot", [own[0][:8], plug, tail])
        elif i == 8:  # a page with a block for the other suffixes to judge
            page("hot", [own[0], own[-1]], plug, tail, around="<article>%s<div class='share'>ask us</div></article>")
            want[8] += "\n\nask us"
        else:
            page("hot", own, *([plug, tail] if i < 20 else []))
    for i in range(24):  # copies but for a block; one article; pages without a host; a host of few articles
        page("copies", [one, words(rng, 10)])
        page("same", [one, plug])
        page(None, [words(rng, 30), plug])
        if i < 19:
            page("small", [words(rng, 30), plug])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == want


def test_html_reader_comments_and_names(spark):
    page = "<article><p>one</p><ol class='comment-list'><li>mine</li></ol><aside>no</aside><div class='ad'>no</div><div role='navigation'>no</div><object>two</object><form><textarea>no</textarea></form></article>"
    assert [t for t, said in html_extract.blocks(page) if said == html_extract.OWN] == ["one", "two"]


def test_html_of_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        inside = re.search("<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>", inside)]
        assert got[p.page_id] == "\n\n".join(b for b in blocks if b)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "An answer\n\nof two parts"), (1, 2, "user", "On Monday A wrote:\n> hello   THERE\n> second line\nI disagree"),
        (1, 3, "assistant", ">> hello there second line\n> i disagree\nfine"), (1, 3, "assistant", "tie"), (2, 0, None, None), (None, 1, "user", "x"), (2, 5, "user", "> nobody said this\nbody"),
    ]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    at = {(r.conv_id, r.turn, r.body): r for r in got}
    assert len(got) == len(rows)
    assert at[1, 2, "I disagree"].parent_turn == 0
    assert (at[1, 3, "fine"].parent_turn, at[1, 3, "fine"].max_level, at[1, 3, "fine"].n_linked) == (2, 2, 2)
    assert (at[1, 3, "tie"].parent_turn, at[1, 3, "tie"].root_turn, at[1, 3, "tie"].depth) == (2, 0, 2)
    assert (at[2, 5, "body"].parent_turn, at[2, 5, "body"].n_linked) == (0, 0)
    assert at[None, 1, "x"].root_turn is None


def quoted_model(rows):
    """(conv, turn, text) -> parent turn of each, by plain Python."""
    norm = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    cut = lambda x: re.split(r"(?<=[.!?])\s+", x)
    level = lambda x: re.match(r"([ \t]*>)*", x)[0].count(">")
    bare = lambda x: re.sub(r"^([ \t]*>)+[ \t]?", "", x)
    said = {}
    for conv, turn, text in rows:
        own = "\n".join("" if level(x) or re.match(r"[ \t]*On .+ wrote:[ \t]*$", x) else x for x in text.split("\n")).strip()
        parts = re.split(r"\n[ \t]*\n", own)
        for u in {norm(own), *map(norm, parts), *map(norm, own.split("\n")), *(s for p in parts for s in cut(norm(p)))} - {""}:
            said[conv, u] = min(turn, said.get((conv, u), turn))
    out = {}
    for conv, turn, text in rows:
        runs, last = [], None
        for x in text.split("\n"):
            n = 0 if re.match(r"[ \t]*On .+ wrote:[ \t]*$", bare(x)) or not norm(bare(x)) else level(x)
            if n and n == last:
                runs[-1][1].append(norm(bare(x)))
            elif n:
                runs.append((n, [norm(bare(x))]))
            last = n
        found = []
        for n, lines in runs:
            whole = " ".join(lines)
            at = said.get((conv, whole), turn)
            if at >= turn:
                units = {u for u in [*lines, *cut(whole)] if u != whole and len(u.split(" ")) >= quotes.MIN_WORDS}
                votes = [t for u in units if (t := said.get((conv, u), turn)) < turn]
                at = max(votes, key=lambda t: (votes.count(t), t), default=None)
            if at is not None and at < turn:
                found.append((n, -at))
        before = max((t for c, t, _ in rows if c == conv and t < turn), default=None)
        out[conv, turn] = (-min(found)[1] if found else before, len(runs), len(found))
    return out


def test_quotes_against_a_model(spark):
    """Whole bodies, parts of paragraphs, lines wrapped anew, nested levels, attributions within, text around quotations."""
    rng, rows = random.Random(12), []
    for conv in range(12):
        bodies = []
        for turn in range(12):
            own = "\n\n".join("\n".join(". ".join(words(rng, rng.randint(2, 5)) for _ in range(rng.randint(1, 3))) + "." for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
            text = own
            if bodies and rng.random() < 0.8:
                other = rng.choice(bodies)
                lines = [x for x in other.split("\n") if x]
                i = rng.randrange(len(lines))
                quote = rng.choice([other.split("\n"), lines[i : i + 2], lines[i].split(". ")[:1], words(rng, 6).split("\n"), re.sub(r"((\S+ ){3})", r"\1\n", " ".join(lines)).split("\n")])
                if rng.random() < 0.3:
                    quote = [*quote, "On Friday B wrote:", *("> " + x for x in rng.choice(bodies).split("\n"))]
                mark = rng.choice(["> ", ">", " > "])
                text = f"On Monday A wrote:\n" + "\n".join(mark + x for x in quote) + "\n" + own
                text = words(rng, 4) + "\n" + text if rng.random() < 0.3 else text
            bodies.append(own)
            rows.append((conv, turn * 3, text))
    df = spark.createDataFrame([(c, t, "user", x, 1, "h") for c, t, x in rows], "conv_id long, turn long, role string, text string, row int, hash string").repartition(3)
    got = quotes.link_quotes(df).collect()
    want = quoted_model(rows)
    assert {(r.conv_id, r.turn): (r.parent_turn, r.n_quotes, r.n_linked) for r in got} == want
    for conv in range(12):
        order = [r.turn for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.reply_key)]
        assert all(want[conv, t][0] is None or order.index(want[conv, t][0]) < i for i, t in enumerate(order))


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    frames = [
        secrets.digest(secrets.find_secrets(d)), decontaminate.contamination(d, d.selectExpr("doc_id as item_id", "text")), packing.pack(d), fingerprints.compare_edits(d), urlfilter.judge_urls(pages), langid.identify(d),
        jaccard_join.jaccard_components(d), suffix_dedup.remove_repeats(d), html_extract.extract(pages), quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


@pytest.fixture(scope="module")
def hard(spark):
    """Null and equal ids, repeated rows, ties, a text of some MB, texts without words; columns that operators use for themselves."""
    rng = random.Random(21)
    long, a, b = words(rng, 700_000), words(rng, 50), words(rng, 150)
    rows = [(1, long), (2, f"{a} {long[:3000]}"), (None, a), (None, a), (None, None), (3, a), (3, a), (3, b), (4, b), (5, ""), (6, " \t\n"), (7, "password=abcdef123 " + a), (7, None), (8, b + " x")]
    full = [(d, t, ["en", None][i % 5 == 4], [f"s{i % 3}", None][i % 4 == 3], len(t) if t and i % 2 else None, i, "x", [1], b"y") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row long, hash string, spans array<int>, kept binary").repartition(3)


def test_hard_rows(spark, hard):
    rows = hard.collect()
    n, data = len(rows), [(r.text or "").encode() for r in rows]
    found = secrets.find_secrets(hard).collect()
    assert (len(found), sum(len(r.base) for r in found)) == (n, 1)
    packed = packing.pack(hard).toPandas()
    assert len(packed[packed.start == 0]) == n
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()
    prints = fingerprints.fingerprints(hard).collect()
    assert len({r.fingerprint for r in prints if r.doc_id in (5, 6)}) == 1
    compared = fingerprints.compare_edits(hard).collect()
    assert sorted(r.n_chars for r in compared) == sorted(len(r.text or "") for r in rows)
    told = langid.identify(hard).collect()
    assert sorted(str(r.lang_pred) for r in told) == ["en"] * 10 + ["und"] * 4
    joined = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(hard).collect()}
    assert {(3, 46, 3), (None, 46, 3), (3, 146, 3), (4, 146, 3), (8, 147, 3), (7, 47, 3), (5, 0, 5), (None, 0, None)} <= joined
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(hard, length=100)).collect()
    assert sorted(r.n_bytes for r in out) == sorted(map(len, data))
    assert {(r.doc_id, r.n_removed) for r in out if r.doc_id in (3, 4)} == {(3, 149), (3, 449), (4, 449)}
    items = spark.createDataFrame([(1, rows[[r.doc_id for r in rows].index(1)].text[-400:]), (None, "password=abcdef123")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(hard, items).collect()} == {(1, 1)}


def test_pipeline_on_hard_rows(spark, hard, tmp_path):
    import corpus_pipeline

    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, None), (2, ""), (3, "no such words anywhere in there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns
            frame = spark.createDataFrame(out.collect(), out.schema)
            if name == "secret_scan":
                assert all(r.n_chars == len(r.text) for r in frame.collect() if r.text is not None)
        pieces = corpus_pipeline.windows(spark, frame, str(tmp_path))
        assert pieces.where("start = 0").count() == frame.count()
    assert frame.count() == 0


def test_pipeline_keeps_what_a_large_model_keeps(spark, monkeypatch):
    """The first stage drops and keeps the same rows where its model doesn't fit into workers; no row is lost for it."""
    import corpus_pipeline

    foreign = [(2**60 + 1, "Все люди рождаются свободными и равными в своем достоинстве и правах.", None, "s", None), (None, "der und die das " * 9, "de", None, 3), (None, None, "en", "s", 4)]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs = given.union(spark.createDataFrame(foreign, given.schema))
    want = corpus_pipeline.language(spark, docs, SF).collect()
    fit = langid.fit
    made = []
    monkeypatch.setattr(langid, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    monkeypatch.setattr(langid, "MAX_CELLS", 1000)
    got = corpus_pipeline.language(spark, docs, SF)
    assert got.schema == docs.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
    assert isinstance(made[0], langid.Spread)
    assert docs.count() - 5 <= len(want) < docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    found = jaccard_join.jaccard_components(spark.read.parquet(f"{SF}/documents.parquet")).where("doc_id = component_id").count()
    hit = {r.doc_id for r in decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not hit
    assert sizes[1] <= found
    assert sizes[3] == sizes[2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
