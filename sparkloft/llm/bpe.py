"""Byte-pair encoding and decoding with a public vocabulary; long text by tree concatenation.

A long text is halved again and again, whatever stands at the middle. The pieces at the leaves are encoded in parallel, and at each
join a window around it is encoded anew, which grows until it agrees with what stands on both sides.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloft.llm.common import small_batches

VOCABULARY = "byte_bpe_50k"
LEAF = 512  # bytes of a piece without any split that are encoded at once
LONG = 4096  # characters; a text of more is encoded as a tree of halves
THREADS = 2  # parts of one very long text that are encoded side by side (the encoder lets other threads run)
SHARED = 16  # leaves from which on a text is shared out over the threads

# Only a run like these can hold a piece of more than LEAF bytes: a character takes four at most.
_LONG_RUN = re.compile(r"\S{%d,}|\s{%d,}" % (LEAF // 4, LEAF // 4))
# A window would have to grow over a run like these; its pieces are trees of their own.
_ENDLESS = re.compile(r"\S{%d,}|\s{%d,}" % (LONG, LONG))


class Tokenizer:
    """Ids of whole texts, equal to the tokenizers library's with add_special_tokens=False."""

    def __init__(self, name: str = VOCABULARY, leaf: int = LEAF, long: int = LONG):
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(f"{name}.json")) as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.leaf, self.long = leaf, long
        self.trees = 0  # long texts that were encoded as trees, and the joins that took
        self.joins = 0
        # the splitting pattern always parts a space from a letter, digit or mark before it: no piece holds the two in this order
        self.opens = np.array([b[:1] in (b" ", b"\n") for b in self.bytes_of])
        self.shuts = np.array([b[-1:].isalnum() or b[-1:] in (b".", b",", b";", b":", b"!", b"?", b")", b'"') for b in self.bytes_of])

    @functools.cached_property
    def pool(self) -> ThreadPoolExecutor:
        return ThreadPoolExecutor(THREADS)

    def piece(self, data: bytes) -> list[int]:
        """Ids of bytes that the splitting pattern leaves in one piece."""
        return self.encoding._encode_single_piece(data)

    def agree(self, left: int, right: int) -> bool:
        """Whether two neighbouring ids stay as they are when encoded together."""
        return self.piece(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two encoded neighbours.

        A row of ids is the encoding of its bytes just when each two neighbours agree. So a window around the join is
        encoded anew and grows until its first and last ids agree with the ids beside it; beyond them nothing changes.
        """
        if not left or not right or self.agree(left[-1], right[0]):
            return left + right
        width = 2
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            ids = self.piece(b"".join(self.bytes_of[i] for i in left[a:] + right[:b]))
            if (a == 0 or self.agree(left[a - 1], ids[0])) and (b == len(right) or self.agree(ids[-1], right[b])):
                return left[:a] + ids + right[b:]
            width *= 2

    def side_by_side(self, f, items: list) -> list:
        """f of each item, in order; of many items each thread takes a share of neighbours."""
        if len(items) < SHARED:
            return [f(x) for x in items]
        share = -(-len(items) // THREADS)
        parts = self.pool.map(lambda k: [f(x) for x in items[k : k + share]], range(0, len(items), share))
        return [x for part in parts for x in part]

    def unsplit(self, data: bytes) -> list[int]:
        """Ids of one unsplit piece of any length: leaves are encoded alone and joined pairwise, level by level."""
        parts = self.side_by_side(self.piece, [data[k : k + self.leaf] for k in range(0, len(data), self.leaf)])
        while len(parts) > 1:
            even = len(parts) // 2 * 2
            joined = self.side_by_side(lambda both: self.join(*both), list(zip(parts[:even:2], parts[1:even:2], strict=True)))
            parts = joined + parts[even:]
        return parts[0] if parts else []

    def seam(self, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        """How many ids at the end of ``left`` and at the start of ``right`` a window around their join has to hold.

        It grows until it begins and ends where the pattern splits whatever stands around: from there on each side's own ids are those
        of the whole text. A side without such a place is in it whole.
        """
        width = 8
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            begins = np.flatnonzero(self.opens[left[a + 1 :]] & self.shuts[left[a:-1]])
            ends = np.flatnonzero(self.opens[right[1:b]] & self.shuts[right[: b - 1]]) if b else np.zeros(0, np.int64)
            if (len(begins) or not a) and (len(ends) or b == len(right)):
                return len(left) - (a + 1 + int(begins[-1]) if len(begins) else 0), int(ends[0]) + 1 if len(ends) else len(right)
            width *= 2

    def concatenate(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Encoding of two neighbouring texts from their own encodings."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        a, b = self.seam(left, right)
        a = len(left) - a
        window = b"".join(map(self.bytes_of.__getitem__, [*left[a:].tolist(), *right[:b].tolist()])).decode()
        self.joins += 1
        return np.concatenate([left[:a], self.plain(window), right[b:]])

    def tree(self, text: str, leaf) -> np.ndarray:
        """Ids of a long text: halves of halves down to LONG characters are encoded in parallel, then joined level by level."""
        cuts = [0, len(text)]
        while cuts[1] > self.long:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        self.trees += 1
        parts = self.side_by_side(leaf, [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        while len(parts) > 1:
            parts = self.side_by_side(lambda both: self.concatenate(*both), list(zip(parts[::2], parts[1::2], strict=True)))
        return parts[0]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one. A special token's string is that token."""
        if not text:
            return np.zeros(0, np.uint32)
        special = self.special
        if not any(s in text for s in special):
            return self.ordinary(text)
        parts = self.split_special.split(text)
        return np.concatenate([np.array([special[p]], np.uint32) if p in special else self.ordinary(p) for p in parts])

    def ordinary(self, text: str) -> np.ndarray:
        """Ids of text in which special tokens' strings mean nothing: a long text is a tree of halves, a long piece one of its own."""
        leaf = self.pieces if _LONG_RUN.search(text) else self.plain
        if len(text) <= self.long or leaf == self.pieces and _ENDLESS.search(text):
            return leaf(text)
        return self.tree(text, leaf)

    def plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def pieces(self, text: str) -> np.ndarray:
        out: list[int] = []
        for word in self.pattern.findall(text):
            data = word.encode()
            out += self.piece(data) if len(data) <= self.leaf else self.unsplit(data)
        return np.array(out, np.uint32)

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")

    @functools.cached_property
    def decimals(self) -> list[str]:
        return [str(i) for i in range(len(self.bytes_of))]


@functools.cache
def tokenizer(name: str = VOCABULARY) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(name)


def encode_texts(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text, an empty array for a null or empty text."""

    def run(batches):
        t = tokenizer(name)
        for b in batches:
            ids = [t.encode(x.as_py()).astype(np.int32) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_texts(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); a null array gives a null text."""

    def run(batches):
        t = tokenizer(name)
        for b in batches:
            texts = [None if x is None else t.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to.

    Encodes and decodes in one pass, one row in and one row out; a null text counts as empty, repeated rows give repeated rows.
    """

    def run(batches):
        t = tokenizer(name)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for x in b.column(1):
                ids = t.encode(x.as_py()).tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(t.decimals.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
