"""Problem 6: token ids of every document by a public byte-level BPE tokenizer.

Method: speculate and verify. Each distinct word (pre-token) gets a proposal by greedy longest match. A sequence of
tokens is the tokenizer's result if and only if every adjacent pair of tokens is: that is tested for all pairs at once in
numpy, by undoing merges of the pair's two sides until a merge shows up that would have gone first. Only words with a
failing pair are merged exactly. No shuffle: one pass over the texts.

Nulls and empty texts have an empty list. Texts that look like special tokens are plain text.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.words import slices

#: Splitting of the texts, in ``re`` (quick) and, for texts with characters on which the two differ, in ``regex``. Fixed values.
FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
EXACT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ODD = regex.compile(r"[\p{No}\p{Nl}\x1c-\x1f]")
NEVER = 1 << 30


def split(text: str) -> list[str]:
    return EXACT.findall(text) if ODD.search(text) else FAST.findall(text)


def byte_letters() -> dict[str, int]:
    """Byte-level BPE files write each byte as a letter: printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Merges by rank: 0..255 are the bytes, 256+i the result of merge i. ``ids`` maps ranks to the vocabulary's ids."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        self.ids, n = ids, len(left)
        self.left = np.concatenate((np.full(256, -1), left)).astype(np.int64)
        self.right = np.concatenate((np.full(256, -1), right)).astype(np.int64)
        text = [bytes([b]) for b in range(256)]
        for i in range(256, 256 + n):
            text.append(text[self.left[i]] + text[self.right[i]])
        self.rank = {t: i for i, t in reversed([*enumerate(text)])}
        self.text, self.runs = text, {}
        self.longest: dict[bytes, int] = {}
        for t in text:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.pair = {(int(a), int(b)): 256 + i for i, (a, b) in reversed([*enumerate(zip(left, right))])}
        self.known_key = np.full(1 << 20, -1, np.int64)
        self.known = np.zeros(1 << 20, bool)
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def parts(cls, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays of a tokenizer file, to be sent to the workers: bounded by the vocabulary, under 1 MB."""
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters, vocab = byte_letters(), model["vocab"]
        rank, ids, sides = {}, [0] * 256, []
        for letter, b in letters.items():
            rank[letter], ids[b] = b, vocab[letter]
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            sides.append((rank[a], rank[b]))
            rank.setdefault(a + b, len(ids))
            ids.append(vocab[a + b])
        sides = np.array(sides, np.int32).reshape(-1, 2)
        return sides[:, 0].copy(), sides[:, 1].copy(), np.array(ids, np.int32)

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at] + 256, NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b together gives a and b again, for each pair.

        Going back in time, the later of the two sides' last merges is undone; the inner neighbours then present must
        have no merge with a rank below that of the undone one (or equal to it, if that lies to the right).
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), NEVER, np.int64)
        while len(live):
            bad = self.merge_of(a, b) < limit
            ok[live[bad]] = False
            undo_a = np.where(a >= 256, a, -1)
            undo_b = np.where(b >= 256, b, -1)
            done = bad | (np.maximum(undo_a, undo_b) < 0)
            go_a = undo_a > undo_b
            limit = np.where(go_a, a, b + 1)
            a, b = np.where(go_a, self.right[a], a), np.where(go_a, b, self.left[b])
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return ok

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` with a direct-mapped cache of pairs, of fixed size."""
        key = a << 32 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        ok, miss = self.known[slot], self.known_key[slot] != key
        if miss.any():
            new, back = np.unique(key[miss], return_inverse=True)
            good = self.compatible(new >> 32, new & 0xFFFFFFFF)
            ok[miss] = good[back]
            at = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            at, first = np.unique(at, return_index=True)
            self.known_key[at], self.known[at] = new[first], good[first]
        return ok

    def greedy(self, raw: bytes) -> list[int]:
        out, i, n, rank, longest = [], 0, len(raw), self.rank, self.longest
        while i < n:
            j = min(n, i + longest.get(raw[i : i + 2], 1))
            while raw[i:j] not in rank:
                j -= 1
            out.append(rank[raw[i:j]])
            i = j
        return out

    def propose(self, word: str) -> list[int]:
        return self.greedy(word.encode("utf-8", "replace"))

    def exact(self, raw: bytes) -> list[int]:
        """Merging in the order of ranks."""
        parts, pair = [*raw], self.pair
        while len(parts) > 1:
            best = min((pair.get(p, NEVER) for p in zip(parts, parts[1:])))
            if best == NEVER:
                break
            a, b, out, i = int(self.left[best]), int(self.right[best]), [], 0
            while i < len(parts):
                if parts[i] == a and i + 1 < len(parts) and parts[i + 1] == b:
                    out.append(best)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def failing(self, proposals: list[list[int]]) -> dict[int, list[int]]:
        """Positions of the pairs that fail, by proposal."""
        counts = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.array([*chain.from_iterable(proposals)], np.int64)
        out: dict[int, list[int]] = {}
        if len(flat) > 1:
            of = np.repeat(np.arange(len(counts)), counts)
            inner = np.flatnonzero(of[1:] == of[:-1])
            bad = inner[~self.verified(flat[inner], flat[inner + 1])]
            first = np.cumsum(counts) - counts
            for w, at in zip(of[bad].tolist(), (bad - first[of[bad]]).tolist()):
                out.setdefault(w, []).append(at)
        return out

    def mended(self, tokens: list[int], bad: list[int]) -> list[int]:
        """Exact merging of each run of tokens that failing pairs hold together. Its ends are verified again."""
        out, i = [], 0
        for at in bad:
            if at < i:  # within the run just merged
                continue
            j = at + 1
            more = set(bad)
            while j in more:
                j += 1
            raw = b"".join(self.text[t] for t in tokens[at : j + 1])
            if (found := self.runs.get(raw)) is None:
                if len(self.runs) > 200_000:
                    self.runs.clear()
                found = self.runs[raw] = self.exact(raw)
            out += tokens[i:at] + found
            i = j + 1
        return out + tokens[i:]

    def encode_words(self, new: list[str]) -> list[list[int]]:
        proposals = [self.propose(w) for w in new]
        open_, tries = [*range(len(new))], 0
        while open_:
            bad = self.failing([proposals[w] for w in open_])
            for k, at in bad.items():
                w = open_[k]
                proposals[w] = self.mended(proposals[w], at) if tries < 3 and len(proposals[w]) > 4 else self.exact(new[w].encode("utf-8", "replace"))
            open_ = [open_[k] for k in bad] if tries < 3 else []
            tries += 1
        return proposals

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        rows = [split(x) if x else [] for x in texts]
        if len(self.cache) > 150_000:
            self.cache.clear()
        cache, words = self.cache, [*chain.from_iterable(rows)]
        new = [*set(words).difference(cache)]
        cache.update(zip(new, self.encode_words(new)))
        tokens = [*map(cache.__getitem__, words)]
        flat = np.array([*chain.from_iterable(tokens)], np.int64)
        ends = np.concatenate(([0], np.cumsum(np.array([*map(len, tokens)], np.int64))))
        counts = np.diff(ends[np.concatenate(([0], np.cumsum(np.array([*map(len, rows)], np.int64))))])
        return self.ids[flat], counts


_LOADED: dict[int, Bpe] = {}


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row of ``df``; ``tokenizer`` is the path of a byte-level BPE file, read on the driver.

    Null or empty text: an empty list. Repeated rows: repeated results. An empty table: no rows. A null id is kept.
    """
    spark = df.sparkSession
    parts = spark.sparkContext.broadcast(Bpe.parts(tokenizer))
    key = hash(tokenizer)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        if key not in _LOADED:
            _LOADED[key] = Bpe(*parts.value)
        bpe = _LOADED[key]
        for batch in batches:
            for part, texts in slices(batch, "text", 1_500_000):
                ids, counts = bpe.encode(texts)
                off = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(off, pa.array(ids))], names=[id_col, "ids"])

    return src.mapInArrow(run, f"{id_col} {kind}, ids array<int>")
