"""Token counts by rank-synchronous merging over ragged numpy arrays.

The texts of a batch are cut into pre-tokens. All pre-tokens that were not seen before lie end to end in
one array of symbol ids; one round finds the lowest merge rank of every sequence and applies that pair at
all its places in every sequence at once, until no sequence has a pair left. The surviving symbols are
the tokens.

A file with settings beyond plain byte-level BPE (a normalizer, a prefix space, tokens of its own that are not special) is
refused. Nulls count as empty text (0 bytes, 0 tokens). Other columns are ignored, rows are kept as they come.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of this byte-level vocabulary.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
NONE = np.int32(2**31 - 1)
#: Pre-tokens whose counts a task remembers, and pre-tokens handled together; both only bound memory.
REMEMBER, TOGETHER = 400_000, 250_000


def _printable() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def refuse(spec: dict) -> None:
    """Raises for a file whose settings would give other tokens than these merges over these pre-tokens do."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    for wrong, what in (
        (model.get("type", "BPE") != "BPE", "model"),
        (spec.get("normalizer") is not None, "normalizer"),
        (cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True), "pre_tokenizer"),
        (any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")), "model settings"),
        (any(not t.get("special") or t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])), "added_tokens"),
    ):
        if wrong:
            raise ValueError(f"not a plain byte-level BPE file: {what}")


class Merges:
    """Merge table of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse(spec)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.span = np.int64(max(vocab.values()) + 1)
        keys = left * self.span + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.first = np.zeros(256, np.int32)
        for char, byte in _printable().items():
            self.first[byte] = vocab[char]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) * self.span + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece."""
        out = np.array([len(p) for p in pieces], np.int64)
        ids = np.flatnonzero(out > 1)
        sizes = out[ids]
        if not len(ids):
            return out
        sym = self.first[np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8)]
        ends = np.cumsum(sizes)
        rank = np.append(self.rank(sym[:-1], sym[1:]), NONE)
        rank[ends - 1] = NONE
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            going = low < NONE
            if not going.all():
                out[ids[~going]] = sizes[~going]
                keep = np.repeat(going, sizes)
                sym, rank, ids, sizes, low = sym[keep], rank[keep], ids[going], sizes[going], low[going]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(low, sizes))
            # places that overlap (a pair of equal symbols in a run): every other one, from the left
            fresh = np.append(True, np.diff(hits) != 1)
            run = np.flatnonzero(fresh)
            hits = hits[(np.arange(len(hits)) - run[np.cumsum(fresh) - 1]) % 2 == 0]
            sym[hits] = self.made[rank[hits]]
            seq = np.repeat(np.arange(len(ids)), sizes)
            stay = np.ones(len(sym), bool)
            stay[hits + 1] = False
            sizes = sizes - np.bincount(seq[hits], minlength=len(ids))
            at = hits - np.arange(len(hits))
            # a merge's second half takes its rank along: what counts is the pair that now starts at the merge
            sym, rank = sym[stay], rank[stay]
            ends = np.cumsum(sizes) - 1
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            last = np.zeros(len(sym), bool)
            last[ends] = True
            rank[touched] = NONE
            touched = touched[~last[touched]]
            rank[touched] = self.rank(sym[touched], sym[touched + 1])
        return out


def counter(merges: Merges):
    """A function from texts to token counts that remembers the counts of pre-tokens."""
    find = regex.compile(PRETOKEN).findall
    cut = regex.compile("|".join(map(regex.escape, merges.special))).split if merges.special else None
    known: dict[str, int] = {}

    def learn(parts: list[list[str]]) -> None:
        new = list(set(chain.from_iterable(parts)) - known.keys())
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = list(set(chain.from_iterable(parts)))
        known.update(zip(new, merges.lengths([p.encode() for p in new]).tolist(), strict=True))

    def count(texts: list[str]) -> list[int]:
        out: list[int] = []
        held: list[tuple[list[str], int]] = []
        waiting = 0

        def flush() -> None:
            learn([p for p, _ in held])
            out.extend(sum(map(known.__getitem__, p)) + extra for p, extra in held)
            held.clear()

        for text in texts:
            pieces = cut(text) if cut else [text]
            parts = find(pieces[0]) if len(pieces) == 1 else list(chain.from_iterable(map(find, pieces)))
            held.append((parts, len(pieces) - 1))
            waiting += len(parts)
            if waiting > TOGETHER:
                flush()
                waiting = 0
        flush()
        return out

    return count


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row's whole text.

    path: byte-level BPE file, read on the driver; its merge table (fixed size) goes to the executors.
    Strings of special tokens inside a text count as that one token, as the library does by default.
    """
    table = df.sparkSession.sparkContext.broadcast(Merges(path))
    kind = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(table.value)
        for b in batches:
            sizes = pc.binary_length(b.column(1)).cast(pa.int64())
            texts = b.column(1).cast(pa.large_string()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(count(texts), pa.int64())], names=["id", *kind.names])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
