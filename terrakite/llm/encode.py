"""Encoding texts with a public byte-level BPE tokenizer, by monoid tree reduction.

A text is halved until its parts are short.  A part carries its ids and where its pre-tokens start.
Two neighbours are joined by scanning again from the last start in the left part that nothing to
its right can move, over a window into the right part that grows until a scanned start is also a
start of the right part: the scan has no memory, so from there on the right part's ids stand.
Decoding concatenates the bytes of tokens up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
LEAF_CHARS = 4096
WINDOW_CHARS = 32
#: How the tokenizer cuts a text into pre-tokens (\s and \S written as the Unicode property), and the most characters past its end that decide a pre-token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCAN = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
LOOKAHEAD = 3


@dataclass(frozen=True)
class Part:
    """A stretch of text: its ids, the starts of its pre-tokens in characters and in ids."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    firsts: np.ndarray


class Codec:
    """One vocabulary: token bytes by rank."""

    def __init__(self, ranks_file: bytes):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.scan = regex.compile(SCAN).finditer
        self.tokens = {i: t for t, i in ranks.items()}
        self.width = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            self.width[i] = len(t)

    def leaf(self, text: str) -> Part:
        ids = np.array(self.bpe.encode_ordinary(text), np.int32)
        starts = np.array([m.start() for m in self.scan(text)], np.int64)
        return Part(text, ids, *self._located(text, ids, starts))

    def _located(self, text: str, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts that are token borders too, and their places among `ids`."""
        lead = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        ends = np.concatenate([[0], np.cumsum(self.width[ids])])
        at = np.searchsorted(ends, lead[starts] if len(starts) else starts)
        good = ends[np.minimum(at, len(ends) - 1)] == (lead[starts] if len(starts) else starts)
        return starts[good], at[good]

    @staticmethod
    def _decided(text: str) -> int:
        """The last place up to which pre-tokens that end there cannot change, whatever follows `text`."""
        return min(len(text) - LOOKAHEAD, len(text.rstrip()) - 1)

    def join(self, a: Part, b: Part) -> Part:
        """The part for a.text + b.text.  Associative; the empty part is neutral."""
        if not a.text or not b.text:
            return b if not a.text else a
        k = int(np.searchsorted(a.starts, self._decided(a.text), "right")) - 1
        p, first = (int(a.starts[k]), int(a.firsts[k])) if k >= 0 else (0, 0)
        tail, w = a.text[p:], WINDOW_CHARS
        while True:
            whole = w >= len(b.text)
            window = tail + b.text[:w]
            sure = len(window) if whole else self._decided(window)
            spans = [m.span() for m in self.scan(window)]
            stop = len(window) if whole else None
            rest = len(b.ids) if whole else 0
            for s, _ in spans:
                if s > sure:
                    break
                if s >= len(tail):
                    j = int(np.searchsorted(b.starts, s - len(tail)))
                    if j < len(b.starts) and b.starts[j] == s - len(tail):
                        stop, rest = s, int(b.firsts[j])
                        break
            if stop is not None:
                break
            w *= 2
        middle, at = [], []
        for s, e in spans:
            if s < stop:
                at.append((p + s, first + len(middle)))
                middle += self.bpe._encode_single_piece(window[s:e].encode())
        after = int(np.searchsorted(b.firsts, rest)) if rest < len(b.ids) or not whole else len(b.starts)
        shift = first + len(middle) - rest
        mid = np.array(at, np.int64).reshape(-1, 2)
        return Part(
            a.text + b.text,
            np.concatenate([a.ids[:first], np.array(middle, np.int32), b.ids[rest:]]),
            np.concatenate([a.starts[: max(k, 0)], mid[:, 0], b.starts[after:] + len(a.text)]),
            np.concatenate([a.firsts[: max(k, 0)], mid[:, 1], b.firsts[after:] + shift]),
        )

    def tree(self, text: str, leaf_chars: int = LEAF_CHARS) -> Part:
        if len(text) <= leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half], leaf_chars), self.tree(text[half:], leaf_chars))

    def encode(self, text: str | None, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if len(text) <= leaf_chars:
            return np.array(self.bpe.encode_ordinary(text), np.int32)
        return self.tree(text, leaf_chars).ids

    def decode(self, ids) -> str:
        def join(lo: int, hi: int) -> bytes:
            if hi - lo <= 1024:
                return b"".join(self.tokens[int(i)] for i in ids[lo:hi])
            mid = (lo + hi) // 2
            return join(lo, mid) + join(mid, hi)

        return join(0, len(ids)).decode()


@lru_cache(maxsize=4)
def _codec(digest: str, holder) -> Codec:
    return Codec(holder.data)


class _Held:
    """The vocabulary file, compared by digest so that a Python worker builds its codec once."""

    def __init__(self, data: bytes):
        self.data, self.digest = data, hashlib.sha256(data).hexdigest()

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest

    def codec(self) -> Codec:
        return _codec(self.digest, self)


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> _Held:
    """The vocabulary file `name`.tiktoken of `folder`, read on the driver; under 1 MB, so it travels with the tasks."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return _Held(f.read())


def encode_column(df: DataFrame, key: str, text: str, vocab: _Held, counts_only: bool = False) -> DataFrame:
    """(key, ids) of every row, in one pass without a shuffle; with `counts_only` (key, n_tokens).

    Null and empty texts give an empty list (0).  A blank text is encoded as it is.  Rows with a
    null or repeated key are encoded like any other.  Strings that look like special tokens are text.
    """
    held = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        codec = held.value.codec()
        for b in batches:
            ids = [codec.encode(t) for t in b.column(1).to_pylist()]
            sizes = np.array([len(i) for i in ids], np.int64)
            if counts_only:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes)], [key, "n_tokens"])
            else:
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], [key, "ids"])

    kind = dict(df.select(key).dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>"))


def decode_column(df: DataFrame, key: str, ids: str, vocab: _Held) -> DataFrame:
    """(key, text) of every row: the inverse of encode_column, but for nulls, which come back empty."""
    held = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        codec = held.value.codec()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {dict(df.select(key).dtypes)[key]}, text string")


def p6_ids(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """The ids of every document's text by byte_bpe_50k."""
    from terrakite.plans.stage import table

    return encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", vocabulary(folder=folder))


def p6_decoded(spark: SparkSession, sf_dir: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """Every document's text decoded from its ids, and how many characters it has: empty for a null text."""
    back = decode_column(p6_ids(spark, sf_dir, folder), "doc_id", "ids", vocabulary(folder=folder))
    return back.select("doc_id", "text", F.length("text").cast("long").alias("n"))


DECODED_SQL = "SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents"
