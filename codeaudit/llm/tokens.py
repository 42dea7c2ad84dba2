"""Token counts of whole texts under a word-end BPE vocabulary, merged in numpy.

Rank-synchronous merging: the new pre-tokens of a group of texts lie end to end
in one symbol array.  In a round every pre-token finds its pair of lowest rank,
all pre-tokens apply theirs at once (at every place, left to right), and
pre-tokens without a mergeable pair leave; their symbols are counted.

Counts are those of the `tokenizers` library without added special tokens.
White space always ends a pre-token, so a text's count is the sum over its
blank-separated words, and each distinct word is merged once per task (the memory
of words is bounded and starts over when it is full).  Texts within the Latin
letters are normalised here; all others by the library's own normaliser and
pre-tokeniser.  Special strings inside a text count as one token each.

Defined results: a null text counts as empty, with no bytes and no tokens.
Repeated rows are counted one by one; a null doc_id is carried.  Empty tables
give empty results; other columns do not take part.  Texts are read whole, and
words are held for bounded groups of texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
GROUP_CHARS = 1 << 21
KNOWN_WORDS = 300_000
NO_RANK = np.iinfo(np.int32).max
# Texts of these characters are normalised by lower-casing and split by blanks.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*"
SPECIAL_SPLIT = r"<\|(?:startoftext|endoftext)\|>"


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The vocabulary as sorted arrays: pairs, their rank and what they become."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.base = np.zeros((2, 256), np.int64)
        for letter, byte in byte_letters().items():
            self.base[:, byte] = vocab[letter], vocab[letter + end]
        self.stride = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        order = np.argsort(left * self.stride + right)
        self.pairs = (left * self.stride + right)[order]
        self.rank = order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each (non-empty) word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        last = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        last[ends - 1] = 1
        symbol = self.base[last, np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        left = np.zeros(len(words), np.int64)
        while symbol.size:
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(start, len(symbol)))
            wanted = symbol[:-1] * self.stride + symbol[1:]
            found = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            usable = (self.pairs[found] == wanted) & (owner[1:] == owner[:-1])
            rank = np.append(np.where(usable, self.rank[found], NO_RANK), NO_RANK)
            best = np.minimum.reduceat(rank, start)
            over = best == NO_RANK
            left[owner[start[over]]] = length[over]
            hit = (rank == np.repeat(best, length)) & (rank < NO_RANK)
            # Overlapping hits (a run of one symbol) merge at every other place.
            at = np.flatnonzero(hit)
            if at.size:
                begin = np.append(True, at[1:] != at[:-1] + 1)
                run = at - at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
                at = at[run % 2 == 0]
                symbol[at] = self.made[found[at]]
            stay = np.repeat(~over, length)
            stay[at + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        return left


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    `tokenizer` is the path of a .json file of the `tokenizers` library: NFC and
    lower case, split into words, byte-level letters, BPE with word ends.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        text = f.read()
    spec = json.loads(text)
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    shared = docs.sparkSession.sparkContext.broadcast((Merges(spec), split, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import regex

        merges, pattern, source = shared.value
        plain, special, pre_tokens = re.compile(PLAIN), re.compile(SPECIAL_SPLIT), regex.compile(pattern)
        to_byte = byte_letters()
        known: dict[str, int] = {}
        library = []

        def learn(fresh: set[str]) -> None:
            names = list(fresh)
            parts = [pre_tokens.findall(w) for w in names]
            counted = merges.count([p.encode() for some in parts for p in some])
            done = np.append(0, np.cumsum(counted))
            stops = np.cumsum([len(some) for some in parts])
            known.update(zip(names, (done[stops] - done[np.append(0, stops[:-1])]).tolist()))

        def by_library(piece: str) -> int:
            if not library:
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_str(source))
            got = library[0].pre_tokenizer.pre_tokenize_str(library[0].normalizer.normalize_str(piece))
            return int(merges.count([bytes(map(to_byte.__getitem__, w)) for w, _ in got if w]).sum())

        def count_group(texts: list[str | None]) -> list[int]:
            totals, words = [0] * len(texts), []
            for i, whole in enumerate(texts):
                pieces = special.split(whole or "") if "<|" in (whole or "") else [whole or ""]
                totals[i] += len(pieces) - 1
                for piece in pieces:
                    if plain.fullmatch(piece):
                        words.append((i, piece.lower().split()))
                    else:
                        totals[i] += by_library(piece)
            if len(known) > KNOWN_WORDS:
                known.clear()
            fresh = set().union(*(w for _, w in words)).difference(known)
            if fresh:
                learn(fresh)
            for i, some in words:
                totals[i] += sum(map(known.__getitem__, some))
            return totals

        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, group, chars = [], [], 0
            for one in texts:
                group.append(one)
                chars += len(one or "")
                if chars >= GROUP_CHARS:
                    counts += count_group(group)
                    group, chars = [], 0
            counts += count_group(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"],
                       F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
