"""Token counts (11): whole-token shortcut.

Offline, before any text is read, every string of the vocabulary is encoded alone: those that are one pre-token, unchanged
by the normalizer, and come back as one token are proven whole. A pre-token that is proven counts one without a merge; only
the others go to the tokenizer's merges. The proven strings are at most as many as the vocabulary has, and are broadcast.

Of a tokenizer that lower-cases, drops white space and splits as packing.Encoder knows, words are found without the
library and remembered; of any other, pre-tokens are the library's. Texts that hold the string of an added token are counted
by the library as a whole, as its default treats it. A sentencepiece model has no pre-tokens: its library counts.

Null or empty text: no tokens, no bytes. Repeated rows are counted each. An id keeps its type, whatever it is. No row is
shuffled. Empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.packing import _LATIN, _PART, _WHOLE, LONG_WORD, NORMALIZER, REMEMBERED, SPLIT, byte_letters, vocabulary
from millrace.llm.shared import one_name

#: More tokens than this are over the limit.
LIMIT = 2048
#: Texts that are split at once.
AT_ONCE = 200
_counters: dict[str, "Counter"] = {}


def _library(path: str) -> object:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def proven(path: str) -> frozenset[str]:
    """The vocabulary's strings, as pre-tokens are written, that encode alone as one token."""
    if not path.endswith(".json"):
        return frozenset()
    tokenizer = _library(path)
    spec = json.loads(tokenizer.to_str())
    end = spec["model"].get("end_of_word_suffix") or ""
    added = {t["content"] for t in spec["added_tokens"]}
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    found = []
    for entry in spec["model"]["vocab"]:
        form = entry[: len(entry) - len(end)]
        if entry in added or not form or not entry.endswith(end) or not of_letter.keys() >= set(form):
            continue
        try:
            found.append((form, bytes(map(of_letter.__getitem__, form)).decode()))
        except UnicodeDecodeError:  # a part of a character is no pre-token
            continue
    encoded = tokenizer.encode_batch([text for _, text in found], add_special_tokens=False)
    split = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else lambda t: [(t, None)]
    same = tokenizer.normalizer.normalize_str if tokenizer.normalizer else lambda t: t
    return frozenset(form for (form, text), e in zip(found, encoded, strict=True) if len(e.ids) == 1 and same(text) == text and [x for x, _ in split(text)] == [form])


class Counter:
    """Numbers of tokens of texts; whole is what proven() found."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        self.whole, self.words = whole, {}
        self.pieces = None
        if not path.endswith(".json"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        self.tokenizer = _library(path)
        spec = json.loads(self.tokenizer.to_str())
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.plain = not spec["model"].get("dropout") and spec["model"]["type"] in ("BPE", "WordPiece", "Unigram", "WordLevel")
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["pattern"] == {"Regex": SPLIT} and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        known = known and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        specials = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        self.by_word = self.plain and known and specials and tuple((spec["normalizer"] or {}).get("normalizers", [])) == NORMALIZER and spec["post_processor"] is None

    def forget(self) -> None:
        self.words = {}

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        texts = ["" if t is None or t != t else t for t in texts]
        if self.pieces is not None:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]
        if not self.by_word:
            return [self._by_pre_token(t) for t in texts]
        split = [None if any(c in t for c in _WHOLE) else t.lower().split() for t in texts]
        every = set(chain.from_iterable(filter(None, split)))
        if len(self.words) + len(every) > REMEMBERED:
            self.forget()
        words = self.words
        new = every.difference(words)
        for w in new:
            words[w] = self._word(w)
        out = [self._library_count(t) if ws is None else sum(map(words.__getitem__, ws)) for t, ws in zip(texts, split, strict=True)]
        for w in new:
            if len(w) > LONG_WORD:
                del words[w]
        return out

    def _word(self, word: str) -> int:
        if word in self.whole and word.isalpha() and word.isascii():
            return 1
        if not _LATIN.fullmatch(word):
            return self._library_count(word)
        return sum([self._pre_token(x if x.isascii() else "".join([self.letters[b] for b in x.encode()])) for x in _PART.findall(word)])

    def _pre_token(self, form: str) -> int:
        return 1 if form in self.whole else len(self.model.tokenize(form))

    def _by_pre_token(self, text: str) -> int:
        t = self.tokenizer
        clean = t.normalizer.normalize_str(text) if t.normalizer else text
        if not self.plain or t.pre_tokenizer is None or any(c in text or c in clean for c in self.added):
            return self._library_count(text)
        return sum([self._pre_token(x) for x, _ in t.pre_tokenizer.pre_tokenize_str(clean)])

    def _library_count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def counter(path: str, whole: frozenset[str]) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, whole)
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Only texts go through Python."""
    path = path or vocabulary()
    d = one_name(docs, {"doc_id": id_col, "text": text_col})
    whole = docs.sparkSession.sparkContext.broadcast(proven(path))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path, whole.value)
        try:
            for batch in texts:
                yield pd.Series([n for at in range(0, len(batch), AT_ONCE) for n in own.counts(batch.iloc[at : at + AT_ONCE])], dtype="int64")
        finally:
            own.forget()  # workers live on after the task

    counted = d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
