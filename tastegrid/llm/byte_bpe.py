"""Byte-level byte-pair encoding and decoding by recursive DuckDB queries in each partition.

A partition's new words become token-position rows. A recursive query joins neighbouring tokens with the
merge table, contracts each word's leftmost pair of least rank and repeats until no pair is left;
an ordered aggregation over the vocabulary turns tokens back into bytes. Texts are cut into words by
numpy, so each distinct word is contracted once per worker, and a text's ids are those of its words in
order. The decoded bytes are held against the text; where they differ (two words with one hash) the
text is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.llm.texts import Memo, Words, pieces, slices, two_columns, unicode_classes

# A step reads all tokens of an open word, so the query's cost and memory grow with the square of its length; a word
# beyond this is contracted by the same rule with a heap.
LONG = 2_048
CHUNK_BYTES, CHUNK_STATE = 400_000, 150_000_000

ENCODE = """
WITH RECURSIVE state(word, tokens, done) AS (
  SELECT word, list(token ORDER BY pos), false FROM start GROUP BY word
  UNION ALL
  SELECT s.word,
    CASE WHEN h.word IS NULL THEN s.tokens
      ELSE s.tokens[:(h.hit & 4294967295) - 1] || [(h.hit >> 32)::INTEGER] || s.tokens[(h.hit & 4294967295) + 2:] END,
    h.word IS NULL
  FROM state s LEFT JOIN (
    SELECT p.word, min((m.rank::BIGINT << 32) + p.pos) AS hit
    FROM (SELECT word, pos, (tokens[pos]::BIGINT << 32) + tokens[pos + 1] AS pair
          FROM (SELECT word, tokens, unnest(range(1, len(tokens))) AS pos FROM state WHERE NOT done)) p
    JOIN merges m ON m.pair = p.pair GROUP BY p.word) h ON h.word = s.word
  WHERE NOT s.done)
SELECT word, tokens FROM state WHERE done ORDER BY word"""

DECODE = """
SELECT t.word, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM coded t JOIN vocabulary v ON v.token = t.token GROUP BY t.word ORDER BY t.word"""


class ByteBpe:
    """``source``: a rank file's bytes, one base64 token and its rank per line."""

    def __init__(self, source: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines()) if a}
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                if t[:i] in self.ranks and t[i:] in self.ranks]
        self.merges = pa.table({"pair": pa.array([(a << 32) + b for a, b, _ in rows], pa.int64()),
                                "rank": pa.array([r for _, _, r in rows], pa.int32())})
        self.vocabulary = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()),
                                    "hex": pa.array([t.hex() for t in self.ranks], pa.string())})
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.classes = unicode_classes()
        self.memo = Memo(800_000)
        self._reset()
        self._con = None

    def _reset(self) -> None:
        self.memo.clear()
        self.ids, self.id_at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.raw, self.raw_at = np.empty(0, np.uint8), np.zeros(1, np.int64)

    def con(self):
        if self._con is None:
            import duckdb
            self._con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
            for name, rows in (("merges", self.merges), ("vocabulary", self.vocabulary)):
                self._con.register("_rows", rows)
                self._con.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
                self._con.unregister("_rows")
        return self._con

    def _by_heap(self, word: bytes) -> list[int]:
        """The same contraction for one long word, in n log n."""
        token = [self.ranks[word[i:i + 1]] for i in range(len(word))]
        size, after, before = [1] * len(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, i, 1, 1) for i in range(len(word) - 1) if (r := self.ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if size[i] else len(word)
            if size[i] != a or j >= len(word) or size[j] != b:
                continue
            token[i], size[i], size[j], after[i] = r, a + b, 0, after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else len(word)
                if y < len(word):
                    k = self.ranks.get(word[x:x + size[x] + size[y]])
                    if k is not None:
                        heapq.heappush(heap, (k, x, size[x], size[y]))
        return [t for t, n in zip(token, size) if n]

    def _contracted(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LONG]
        for k, w in enumerate(words):
            if not w or len(w) > LONG:
                out[k] = np.array(self._by_heap(w) if w else [], np.int32)
        con = self.con()
        at = 0
        while at < len(short):
            part, size, state = [], 0, 0
            while at < len(short) and size < CHUNK_BYTES and state < CHUNK_STATE:
                n = len(words[short[at]])
                part.append(short[at])
                size += n
                state += 8 * n * n
                at += 1
            length = np.array([len(words[k]) for k in part])
            start = pa.table({
                "word": np.repeat(np.arange(len(part), dtype=np.int32), length),
                "pos": (np.arange(size) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32),
                "token": self.byte[np.frombuffer(b"".join(words[k] for k in part), np.uint8)]})
            con.register("start", start)
            tokens = con.sql(ENCODE).to_arrow_table().column("tokens").combine_chunks()
            con.unregister("start")
            flat, ends = tokens.flatten().to_numpy(), tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            for k, a, b in zip(part, ends[:-1].tolist(), ends[1:].tolist()):
                out[k] = flat[a:b]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        return [x.tolist() for x in self._contracted(words)]

    def _expanded(self, ids: np.ndarray, size: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all id lists, end to end, and the length of each; lists of ``size`` ids follow each other."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.vocabulary.num_rows:
            raise ValueError("an id is not in the vocabulary")
        con, n = self.con(), np.zeros(len(size), np.int64)
        con.register("coded", pa.table({"word": np.repeat(np.arange(len(size), dtype=np.int32), size), "token": ids.astype(np.int32),
                                        "pos": np.arange(len(ids), dtype=np.int32)}))
        found = con.sql(DECODE).to_arrow_table().combine_chunks()
        con.unregister("coded")
        if not found.num_rows:
            return b"", n
        n[found.column("word").to_numpy()] = pc.binary_length(found.column("hex")).to_numpy() // 2
        return bytes.fromhex("".join(found.column("hex").to_pylist())), n

    def decode_lists(self, lists: list[list[int]]) -> list[bytes]:
        """Bytes of each id list; an id outside the vocabulary raises."""
        if any(t is None for ids in lists for t in ids):
            raise ValueError("an id is not in the vocabulary")
        flat, n = self._expanded(np.array([t for ids in lists for t in ids], np.int64), np.array([len(ids) for ids in lists], np.int64))
        ends = np.append(0, np.cumsum(n)).tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _learn(self, h: np.ndarray, words: list[bytes]) -> np.ndarray:
        lists = self._contracted(words)
        ids, size = np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
        raw, n = self._expanded(ids, size)
        rows = self.memo.add(h)
        self.ids = np.append(self.ids, ids)
        self.id_at = np.append(self.id_at, self.id_at[-1] + np.cumsum(size))
        self.raw = np.append(self.raw, np.frombuffer(raw, np.uint8))
        self.raw_at = np.append(self.raw_at, self.raw_at[-1] + np.cumsum(n))
        return rows

    def encode(self, texts: list[str]) -> list[tuple[list[np.ndarray], list[bytes]]]:
        """Per text the id arrays and the decoded bytes of its words, in order."""
        w = Words(texts, self.classes, join_space=True, single_numbers=False, keep_space=True)
        if self.memo.n > self.memo.limit:
            self._reset()
        code, unique = pd.factorize(w.hashes)
        rows = self.memo.find(unique)
        new = np.flatnonzero(rows < 0)
        if len(new):
            where = np.full(len(unique), -1, np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            rows[new] = self._learn(unique[new], [w.text(k).encode("utf-8", "surrogatepass") for k in where[new]])
        ids = [self.ids[a:b] for a, b in zip(self.id_at[rows].tolist(), self.id_at[rows + 1].tolist())]
        flat = self.raw.tobytes() if len(rows) > 200_000 else None
        raw = [(flat[a:b] if flat is not None else self.raw[a:b].tobytes())
               for a, b in zip(self.raw_at[rows].tolist(), self.raw_at[rows + 1].tolist())]
        code = code.tolist()
        return [self._text(t, code[a:b], ids, raw) for t, a, b in zip(texts, w.first[:-1].tolist(), w.first[1:].tolist())]

    def _text(self, text: str, code: list[int], ids: list, raw: list[bytes]):
        decoded = b"".join([raw[c] for c in code])
        if decoded != text.encode("utf-8", "surrogatepass"):
            w = Words([text], self.classes, join_space=True, single_numbers=False, keep_space=True)
            lists = self.encode_words([w.text(k).encode("utf-8", "surrogatepass") for k in range(len(w.starts))])
            return [np.array(x, np.int32) for x in lists], b"".join(self.decode_lists(lists))
        return [ids[c] for c in code], decoded


def _shared(spark, path: str):
    """The tables, built once on the driver; as large as the rank file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(ByteBpe(f.read()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): one row per row of ``docs``; null and empty texts give an empty array."""
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for keys, texts in slices(batches):
            ids = [np.concatenate([*x, np.empty(0, np.int32)]) for x, _ in bpe.encode(texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})
    return two_columns(docs, id_col, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, bytes binary): the bytes of each id array; null arrays give empty bytes, unknown
    ids raise."""
    shared = _shared(coded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = bpe.decode_lists([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "bytes": pa.array(raw, pa.binary())})
    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(
        run, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the decimal ids
    joined by commas and of the bytes the ids decode to. A null text is empty; repeated rows and
    null ids stay as they are."""
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for keys, texts in slices(batches):
            written: dict[int, bytes] = {}
            n, a, b = [], [], []
            for lists, raw in bpe.encode(texts):
                parts, count = [], 0
                for x in lists:
                    s = written.get(id(x))
                    if s is None:
                        s = written[id(x)] = ",".join(map(str, x.tolist())).encode()
                    parts.append(s)
                    count += len(x)
                n.append(count)
                a.append(hashlib.sha256(b",".join(parts)).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(n, pa.int64()),
                                              "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)})
    return two_columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), ``n_tokens`` and ``decodes`` (whether the ids decode to the text's bytes)
    after its own columns. A null text has no ids. Columns of these names are replaced."""
    shared = _shared(docs.sparkSession, path)
    own = [c for c in docs.columns if c not in ("ids", "n_tokens", "decodes")]
    rows = docs.select(*own)
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for part in pieces(batch, at):
                texts = [t or "" for t in part.column(at).to_pylist()]
                coded = bpe.encode(texts)
                ids = [np.concatenate([*x, np.empty(0, np.int32)]) for x, _ in coded]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([raw == t.encode("utf-8", "surrogatepass") for (_, raw), t in zip(coded, texts)], pa.bool_())],
                    names=[*part.schema.names, "ids", "n_tokens", "decodes"])
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("decodes", T.BooleanType())])
    return rows.mapInArrow(run, schema)
