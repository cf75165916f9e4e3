"""Token counts, collocations and the manifest against the library, brute force and a plain tree."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import collocations, merkle, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n long, hash string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, ids beyond 2^53 beside them, equal ids and rows, odd letters, a very long text, clashing columns."""
    rng = random.Random(7)
    words = ["the", "Old", "river", "bank", "of", "a", "stone's", "é", "naïve", "日本", "token", "x" * 90, "<|endoftext|>", "3.14", "!!", "İ", "don't", " ", "\u001c"]
    texts = [None, "", " \n\t", "a\nb", "the river bank " * 30, "the river bank, of a stone's throw " * 12, "go" * 3, " ".join(rng.choice(words) for _ in range(60_000))]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", "\n", ", ", ". "]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows = [(rng.choice([None, 2**60 + 1, *range(50)]), rng.choice(texts), rng.choice([None, "en", "und", "de"]), rng.choice([None, "", "é", "z", "s1", "s1", "s1"]), rng.choice([None, 5]), 1, 2, "h") for _ in range(150)]
    return spark.createDataFrame([*rows, *rows[:20], (9, texts[7], "en", "s1", 1, 1, 2, "h")], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_library_s(docs, empty, name):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := count(r.text or ""), n > 100) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, token_counts.token_counts(docs, path=path, limit=100).collect()), key=repr) == want
    assert token_counts.token_counts(empty, path=path).collect() == []


def test_proven_strings_encode_alone():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, found = Tokenizer.from_file(path), token_counts.proven(path)
    assert 30_000 < len(found) < 49_406
    assert all(len(library.encode(x, add_special_tokens=False).ids) == 1 for x in sorted(found)[:3000] if x.isascii())
    assert "the" in found
    assert "<|endoftext|>" not in found


def ngrams(docs):
    """f by language and phrase, and all words by language, one piece after another."""
    f, n = {}, Counter()
    for r in docs.collect():
        lang = r.lang or "und"
        text = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[" ".join(w[i : i + k])] += 1
    return f, n


def ranked(docs, least, top):
    f, n = ngrams(docs)
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            w = phrase.split(" ")
            if len(w) < 2 or a < least:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[" ".join(w[:k])] + counts[" ".join(w[k:])]), k, counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w)))
            longer = [c for p, c in counts.items() if c >= least and len(v := p.split(" ")) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if not any(100 * c >= 80 * a for c in longer):
                found.append((-score, -a, phrase.encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("one_in", "longest", "bits", "block", "top"), [(64, 4096, 27, 3_000_000, 2000), (2, 5, 16, 500, 7), (1, 4096, 17, 2000, 50), (10**9, 3, 27, 10_000, 2000)])
def test_collocations_against_brute_force(docs, empty, monkeypatch, one_in, longest, bits, block, top):
    """However texts are cut, whatever the bitmaps leave out."""
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    small = docs.where("length(text) < 3000 or text is null")
    want = ranked(small, 8, top)
    assert len(want) > 20
    assert sorted(map(tuple, collocations.collocations(small, least=8, top=top, one_in=one_in, longest_chunk=longest, block_bytes=block).collect())) == want
    assert collocations.collocations(empty).collect() == []


def test_parse_covers_each_word_once():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)).encode() for n in (0, 1, 3, 50, 400)]
    for one_in in (1, 3, 50):
        found = collocations.parse(texts, one_in)
        for i, text in enumerate(texts):
            own = [w for t, n, chunk in found if t == i for w in chunk.split()[:n]]
            assert own == text.split()
    both = collocations.parse([texts[4], b"q r s t " + texts[4]], 3)
    chunks = [[c for t, _, c in both if t == i] for i in (0, 1)]
    assert len(set(chunks[0]) & set(chunks[1])) >= len(set(chunks[0])) - 1


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(values):
    """The top, and of each value the nodes left and right of its path."""
    paths, now, at = [[] for _ in values], list(values), list(range(len(values)))
    while len(now) > 1:
        for k, i in enumerate(at):
            run = now[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
        at = [i // 3 for i in at]
        now = [H(*now[i : i + 3]) for i in range(0, len(now), 3)]
    return now[0], paths


def plain_manifest(rows):
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(*map(mark, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([own[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, _, at, r), path in zip(sorted(by[s], key=lambda x: x[:3]), own[s][1], strict=True):
            path = path + above[k]
            tampered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf(r, r.text.replace("\n", "")) if tampered else at
            for left, right in path:
                node = H(*left, node, *right)
            out.append((r.doc_id, at, own[s][0], root, H(*[x for a, b in path for x in a + b]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("part", "levels"), [(25_000, 6), (20, 2), (3, 1)])
def test_manifest_against_a_plain_tree(docs, monkeypatch, part, levels):
    monkeypatch.setattr(merkle, "PART_ROWS", part)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=repr) == plain_manifest(docs.collect())


def test_manifest_of_many_sources_few_and_none(spark, empty, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 10)
    rows = [(i, "a\nb", "en", f"source {i % 83}", 3, 1, 1, "") for i in range(120)]
    many = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(many, keep_siblings=True)
    got = found.collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == plain_manifest(many.collect())
    assert all(H(r.siblings) == r.proof_sha256 and len(r.siblings) % 64 == 0 for r in got)
    one = many.limit(1)
    assert [tuple(r) for r in merkle.manifest(one).collect()] == plain_manifest(one.collect())
    assert merkle.manifest(empty).collect() == []


def test_a_part_asks_for_the_fewest_nodes():
    """Without any one of the nodes asked for, some proof can't be made; with them, all can."""
    for n in (1, 2, 9, 27, 40):
        for first in range(0, n, 5):
            for end in range(first + 1, n + 1, 4):
                asked = merkle.lacking(first, end, n)
                level_sizes, m, need = {}, n, set()
                for level in range(merkle.height(n)):
                    level_sizes[level], m = m, -(-m // 3)
                known = {(0, i) for i in range(first, end)}
                for level in range(merkle.height(n)):
                    for i in {i for v, i in known if v == level}:
                        run = range(i // 3 * 3, min(i // 3 * 3 + 3, level_sizes[level]))
                        need |= {(level, j) for j in run if (level, j) not in known}
                    known |= {(level + 1, i // 3) for v, i in known if v == level}
                assert len(asked) == len(set(asked))
                assert set(asked) == need
