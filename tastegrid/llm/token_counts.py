"""Token counts by prefix dynamic programming.

For a byte-pair vocabulary with word ends, the tokens of every prefix of a word follow from
the tokens of its shorter prefixes: the last token of prefix i is the one vocabulary entry
that ends there and may stand after the last token of the prefix it leaves. One pass over a word
gives the exact count at each of its prefixes, in time linear in its length; a text's counts are
the running sum over its words. Truncation and budget questions read that table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tastegrid.llm.texts import Memo, Words, slices, two_columns, unicode_classes

NEVER = 1 << 60


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    where it is printable in Latin-1, else the next free one from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts of a ``tokenizers`` file of kind BPE with end-of-word marks, lower case, NFC.
    ``source`` is the file's text. Null texts are empty; every text has a defined count."""

    def __init__(self, source: str):
        data = json.loads(source)
        model = data["model"]
        self.mark = model["end_of_word_suffix"]
        self.specials = [t["content"] for t in data["added_tokens"]]
        to_byte = byte_chars()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids: dict[str, int] = {}
        for s in model["vocab"]:
            ids.setdefault(s, len(ids))
        self.rank = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}
        made = {ids[a + b]: (ids[a], ids[b], k) for k, (a, b) in reversed(list(enumerate(merges)))}
        names = list(ids)
        n = len(names)
        born = [made[t][2] if t in made else -1 for t in range(n)]
        if any(k <= max(born[a], born[b]) for (a, b), k in self.rank.items()):
            raise ValueError("merges must be listed after those that make their parts")
        # Right and left spines, leaf first: (symbol, rank at which it disappears into the next).
        self.right: list[tuple] = [()] * n
        self.left: list[tuple] = [()] * n
        for t in sorted(range(n), key=born.__getitem__):
            if t in made:
                a, b, k = made[t]
                self.right[t] = (*self.right[b][:-1], (b, k), (t, NEVER))
                self.left[t] = (*self.left[a][:-1], (a, k), (t, NEVER))
            else:
                self.right[t] = self.left[t] = ((t, NEVER),)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        sound = set()
        for t in sorted(range(n), key=born.__getitem__):
            name = names[t]
            end = name.endswith(self.mark)
            raw = bytes(to_byte[c] for c in (name[:-len(self.mark)] if end else name))
            if t in made:
                a, b, k = made[t]
                if a not in sound or b not in sound or self.first_join(a, b) != k:
                    continue
            elif len(raw) != 1:
                continue
            sound.add(t)
            (self.final if end else self.inner)[raw] = t
        self.inner_tails = {raw[i:] for raw in self.inner for i in range(len(raw))}
        self.final_tails = {raw[i:] for raw in self.final for i in range(len(raw))}
        self.fits: dict[int, bool] = {}
        self.classes = unicode_classes()
        self.memo, self.store = Memo(), np.empty(0, np.int32)

    def first_join(self, a: int, b: int) -> int:
        """Rank of the first merge across the border when a and b are built side by side. Of
        two merges of equal rank the left one comes first."""
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, dx), (y, dy) = xs[i], ys[j]
            m = self.rank.get((x, y))
            if m is not None and m < dx and m <= dy:
                return m
            if dx == NEVER and dy == NEVER:
                return NEVER
            if dx < dy:
                i += 1
            else:
                j += 1

    def _last(self, word: bytes, i: int, last: list[int], vocab: dict[bytes, int], tails: set[bytes]) -> tuple[int, int]:
        """(token, start) of the last token of word[:i]."""
        for at in range(i - 1, -1, -1):
            piece = word[at:i]
            if piece not in tails:
                break
            t = vocab.get(piece)
            if t is None:
                continue
            if at == 0:
                return t, 0
            key = last[at] * 1_000_003 + t
            ok = self.fits.get(key)
            if ok is None:
                if len(self.fits) > 2_000_000:
                    self.fits.clear()
                ok = self.fits[key] = self.first_join(last[at], t) == NEVER
            if ok:
                return t, at
        raise ValueError("the vocabulary has no token for a byte")

    def word(self, word: bytes) -> tuple[list[int], list[int]]:
        """(last, count) for every prefix, without a word end; entry 0 is the empty prefix."""
        last, count = [-1], [0]
        for i in range(1, len(word)):
            t, at = self._last(word, i, last, self.inner, self.inner_tails)
            last.append(t)
            count.append(count[at] + 1)
        return last, count

    def word_count(self, word: bytes) -> int:
        last, count = self.word(word)
        return count[self._last(word, len(word), last, self.final, self.final_tails)[1]] + 1

    def word_prefixes(self, word: str) -> np.ndarray:
        """Tokens of each prefix of the word, by characters; a cut contraction ('r of 're) is an
        apostrophe and a word of its own."""
        if word[0] == "'" and len(word) > 1:
            cut = [1] + [1 + int(n) for n in self.word_prefixes(word[1:])]
            return np.array([*cut[:-1], self.word_count(word.encode())])
        raw = word.encode("utf-8", "surrogatepass")
        last, count = self.word(raw)
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word])
        return np.array([count[self._last(raw, int(i), last, self.final, self.final_tails)[1]] + 1 for i in ends])

    def normalise(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def pieces(self, text: str) -> list[str | None]:
        """The text cut at special strings, which stand as None."""
        parts: list[str | None] = [text]
        for s in self.specials:
            if s in text:
                cut: list[str | None] = []
                for p in parts:
                    for k, q in enumerate(p.split(s) if p is not None else [None]):
                        cut += [None, q] if k else [q]
                parts = cut
        return parts

    def _words(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        w = Words(texts, self.classes, join_space=False, single_numbers=True, keep_space=False)
        code, unique = pd.factorize(w.hashes)
        if self.memo.n > self.memo.limit:
            self.memo.clear()
            self.store = np.empty(0, np.int32)
        rows = self.memo.find(unique)
        new = np.flatnonzero(rows < 0)
        if len(new):
            where = np.full(len(unique), -1, np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]  # one place of each word
            counts = [self.word_count(w.text(k).encode("utf-8", "surrogatepass")) for k in where[new]]
            rows[new] = self.memo.add(unique[new])
            self.store = np.append(self.store, np.array(counts, np.int32))
        return w, self.store[rows][code] if len(code) else np.empty(0, np.int32)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        flat, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            for p in self.pieces(t):
                if p is None:
                    extra[k] += 1
                elif p:
                    flat.append(self.normalise(p))
                    owner.append(k)
        if flat:
            w, tokens = self._words(flat)
            running = np.append(0, np.cumsum(tokens, dtype=np.int64))
            np.add.at(extra, owner, running[w.first[1:]] - running[w.first[:-1]])
        return extra.tolist()

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix of the normalised text without special strings: entry i for
        its first i characters."""
        text = self.normalise(text)
        out = np.zeros(len(text) + 1, np.int64)
        if text:
            w, tokens = self._words([text])
            for k, n in enumerate(tokens):
                s, e = int(w.starts[k]), int(w.ends[k])
                out[s + 1:e + 1] = out[s] + self.word_prefixes(text[s:e])
                following = int(w.starts[k + 1]) if k + 1 < len(tokens) else len(text)
                out[e:following + 1] = out[s] + int(n)
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of the normalised text within the budget: answered
        from the word sums and the prefixes of the words around the border."""
        text = self.normalise(text)
        if not text:
            return 0
        w, tokens = self._words([text])
        running = np.append(0, np.cumsum(tokens, dtype=np.int64))
        k = int(np.searchsorted(running, budget, "right")) - 1  # whole words that fit
        if k >= len(tokens):
            return len(text)
        s, e = int(w.starts[k]), int(w.ends[k])
        within = np.flatnonzero(running[k] + self.word_prefixes(text[s:e]) <= budget)
        return s + (int(within[-1]) + 1 if len(within) else 0)


def _counter(spark, path: str):
    """The tables, built once on the driver. Their size is that of the vocabulary file."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(PrefixCounter(f.read()))


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars), one row per row of ``docs``.

    ``path``: a tokenizers file, read on the driver. ``limit_chars``: characters of the longest
    prefix of the normalised text that keeps the limit, from the prefix table (null if within
    the limit or if the text holds special strings). A null text is empty; repeated rows and null ids stay."""
    shared = _counter(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for ids, texts in slices(batches):
            n = c.counts(texts)
            cut = [c.longest_prefix(t, limit) if k > limit and not any(s in t for s in c.specials) else None
                   for t, k in zip(texts, n)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([k > limit for k in n], pa.bool_()),
                "limit_chars": pa.array(cut, pa.int64())})
    return two_columns(docs).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, prefix_tokens array<int>): the exact count at every prefix, entry i for the
    first i characters of the normalised text."""
    shared = _counter(docs.sparkSession, path)

    def run(batches):
        c = shared.value
        for ids, texts in slices(batches, 1 << 16):
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()),
                "prefix_tokens": pa.array([c.prefixes(t).astype(np.int32) for t in texts], pa.list_(pa.int32()))})
    return two_columns(docs).mapInArrow(run, "doc_id long, prefix_tokens array<int>")
