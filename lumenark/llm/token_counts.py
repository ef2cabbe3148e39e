"""Token counts of a unigram model without its tokens: an automaton finds the pieces, a Viterbi pass carries score and count.

The vocabulary (pieces and scores) is read from a sentencepiece file and used as a unigram model with byte fallback, by
the rules of the tokenizers library: "▁" before the text and for each space; among equal scores the path that reached a
place first stays, that is the one whose last piece starts first; a character without a piece of its own costs the least
score less 10 and counts as its bytes (or, without byte pieces, as one token for each run of such characters).

No piece has "▁" after another character, so a text falls apart before each run of "▁" and the parts are counted one by
one; scores add up exactly as they are whole numbers. If some piece did, texts would be counted whole.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import documents_of, map_chunks

MARK, UNKNOWN_PENALTY, MEMO = "▁", 10.0, 400_000
_open: dict[str, Counter] = {}


class Counter:
    """Counts for one vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.least = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.apart = not any(MARK in p.lstrip(MARK) for p in names)
        self.memo: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Tokens of a text that is not split further."""
        n = len(text)
        ending: list[list] = [[] for _ in range(n)]
        for end, found in self.find.iter(text):
            ending[end].append(found)  # longest first
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(n):
            best, at, size, single = None, 0, 0, False
            for length, s in ending[i]:
                if length == 1:
                    single = True
                x = score[i + 1 - length] + s
                if best is None or x > best:
                    best, at, size = x, i + 1 - length, 1
            odd = False
            if not single:
                x = score[i] + self.least
                if best is None or x > best:
                    best, at, odd = x, i, True
                    size = len(text[i].encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown[i])
            score[i + 1], count[i + 1], unknown[i + 1] = best, count[at] + size, odd
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.apart:
            return self.part(marked)
        memo, total = self.memo, 0
        for p in re.findall("▁+[^▁]*|[^▁]+", marked):
            n = memo.get(p)
            if n is None:
                if len(memo) > MEMO:
                    memo.clear()
                n = self.part(p)
                if len(p) <= 64:
                    memo[p] = n
            total += n
        return total


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores, by id, of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def counter(path: str) -> Counter:
    if path not in _open:
        _open[path] = Counter(pieces_of(path))
    return _open[path]


def _batch(path: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        c = counter(path)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens) of each document. Null and empty texts have no tokens; null and repeated ids are counted
    row by row; other columns are ignored; an empty table gives an empty result."""
    return map_chunks(documents_of(docs, id_col, text_col), _batch(vocabulary or default_path()), "doc_id long, n_chars long, n_tokens long").select("doc_id", F.col("n_chars"), "n_tokens")
