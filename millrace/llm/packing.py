"""Packing (3): best-fit decreasing into windows of a fixed number of tokens.

Tasks tokenize whole texts and cut those beyond a window into full windows and a rest. Pieces are then dealt by a hash of
document and start to as many bins as the tokens need, each of a bounded number of tokens and rows, and each bin is
packed on its own: longest piece first, into the open window with the least room that still takes it. Windows that are
open are kept by remaining capacity, in a segment tree over capacities, so a piece costs log2(window) steps.
A bin wastes about one window, and no source, language or copy meets in one bin.

Text null or empty: the end id alone. Documents without tokens and empty tables give no sequences. Repeated rows are packed each.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import one_name, scratch, with_id

WINDOW = 2048
END_ID = 1
#: Words that a task remembers the ids of; how many changes nothing but the time. Longer words aren't remembered.
REMEMBERED, LONG_WORD = 300_000, 64
#: A bin has about so many tokens and rows.
BIN_TOKENS, BIN_ROWS = 4_000_000, 100_000
#: How a tokenizer normalizes and splits text whose words Encoder may take one by one.
NORMALIZER = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same split for words of Latin letters below U+0250, and what such words are made of.
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_LATIN = re.compile("[!-@\\[-~\u00c0-\u024f]+")
#: What makes a text go to the tokenizer as it is: controls that str.split() takes for white space, letters whose lower
#: case depends on others or is two characters, and the beginning of special tokens.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", "\u0130", "<|")
_tokenizers: dict[str, "Encoder"] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: its own if it is printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    Of a tokenizer that lower-cases, drops white space and never joins over it or over its split, a text's ids are those of
    its words' parts in turn: parts go to the model alone, and words are remembered. Any other tokenizer, and texts and
    words that these rules don't cover, are encoded by the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        normalizers = (spec["normalizer"] or {}).get("normalizers", [])
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["pattern"] == {"Regex": SPLIT} and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        known = known and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        specials = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        self.by_word = known and specials and tuple(normalizers) == NORMALIZER and spec["post_processor"] is None and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
        self.model = self.tokenizer.model
        self.id_bytes = [int(i).to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def forget(self) -> None:
        self.words.clear()
        self.parts.clear()

    def texts(self, texts: list[str | None]) -> list[bytes]:
        texts = ["" if t is None or t != t else t for t in texts]
        if not self.by_word:
            return list(map(self._whole, texts))
        split = [None if any(c in t for c in _WHOLE) else t.lower().split() for t in texts]
        every = set(chain.from_iterable(filter(None, split)))
        new = every.difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.forget()
            new = every
        self._learn(new)
        words = self.words
        out = [self._whole(t) if ws is None else b"".join(map(words.__getitem__, ws)) for t, ws in zip(texts, split, strict=True)]
        for w in new:
            if len(w) > LONG_WORD:
                del words[w]
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Remembers the ids of words; most are letters and what punctuation stands behind them."""
        words, parts, part = self.words, self.parts, self._part
        for w in new:
            core = w.rstrip(".,;:!?")
            if core.isalpha() and (core.isascii() or _LATIN.fullmatch(core)):
                got = parts.get(core) or part(core)
                words[w] = got if len(core) == len(w) else got + (parts.get(w[len(core) :]) or part(w[len(core) :]))
            elif _LATIN.fullmatch(w):
                words[w] = b"".join([parts.get(x) or part(x) for x in _PART.findall(w)])
            else:
                words[w] = self._whole(w)

    def _part(self, part: str) -> bytes:
        own = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        got = b"".join([self.id_bytes[x.id] for x in self.model.tokenize(own)])
        if len(part) <= LONG_WORD:
            self.parts[part] = got
        return got


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, row (a number of its own for each document), start, length, ids_crc32, doc_tokens[, ids binary], a written table."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        try:
            for batch in batches:
                for at in range(0, len(batch), 500):
                    part = batch.iloc[at : at + 500]
                    out = []
                    for doc, row, ids in zip(part["doc_id"], part["row"], enc.texts(list(part["text"])), strict=True):
                        ids += end
                        n = len(ids) // 4
                        for start in range(0, n, window):
                            piece = ids[4 * start : 4 * (start + window)]
                            out.append((doc, row, start, len(piece) // 4, zlib.crc32(piece), n, *([piece] if keep_ids else [])))
                    yield pd.DataFrame(out, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids])
        finally:
            enc.forget()  # workers live on after the task

    docs = docs.withColumn("row", F.monotonically_increasing_id())
    return scratch(with_id(docs, cut, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids), "pieces")


class Windows:
    """Open windows by remaining capacity: a segment tree whose leaves are stacks of windows."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.held = [0] * (2 * self.size)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def put(self, room: int, window: tuple[int, int]) -> None:
        self.at[room].append(window)
        i = room + self.size
        while i:
            self.held[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, tuple[int, int]] | None:
        """A window of the tightest capacity that isn't less."""
        i = least + self.size
        while not self.held[i]:
            while i & 1:  # a right child: nothing to its right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.held[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.held[i] -= 1
            i >>= 1
        return room, self.at[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, given in decreasing order."""
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, n = Windows(window), 0
    for i, length in enumerate(lengths.tolist()):
        got = open_.take(length)
        room, (s, used) = got if got else (window, (n, 0))
        n += not got
        seq[i], offset[i] = s, used
        if room > length:
            open_.put(room - length, (s, used + length))
    return seq, offset


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset, padding of its sequence.

    A sequence is padded to the window unless its length is a power of two.
    """
    cut = pieces(one_name(docs, {"doc_id": id_col, "text": text_col}), path or vocabulary(), window, end_id, keep_ids)
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")).first()
    bins = max(1, -(-total["tokens"] // BIN_TOKENS), -(-total["rows"] // BIN_ROWS))
    # by rows, as documents may be repeated; a null id goes to Python as a number and a mark, or all ids of its bin would be doubles
    cut = cut.withColumns({"bin": F.pmod(F.xxhash64("row", "start"), F.lit(bins)), "none": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})

    def fill(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable")
        seq, offset = best_fit(b["length"].to_numpy(), window)
        used = np.bincount(seq, b["length"].to_numpy()).astype(np.int64)
        pad = np.where((used & (used - 1)) == 0, 0, window - used)
        return b.drop(columns=["bin", "row"]).assign(sequence_id=b["bin"].to_numpy() * (1 << 32) + seq, offset=offset, padding=pad[seq])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.drop("bin", "row").schema.fields)
    filled = cut.groupBy("bin").applyInPandas(fill, f"{fields}, sequence_id long, offset long, padding long")
    return filled.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")
