"""Token ids of whole texts by a byte-level BPE vocabulary file, through the tokenizers library.

Byte-level BPE encodes each pre-token by itself, and no pre-token reaches over a space into the word before it, nor over a
single line break between two words. So the ids of a text are those of its words, each with the space before it. A batch of
texts is split in Arrow and its words are numbered; only its distinct words are looked up in a memo of bounded size, only
those that are new are encoded by the library's model, and Arrow puts the ids together by the words' numbers. Texts with
other white space, or with control characters, where the rule does not hold, are encoded as a whole, and so is every text if
the file asks for another normalizer, pre-tokenizer or model.
"""

from __future__ import annotations

import gc
import json
import os
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words in each half of the memo; longer words than LONGEST are not kept.
MEMO, LONGEST = 250_000, 48
#: Bytes of text whose words are numbered at once.
BATCH_BYTES = 4 << 20
#: Control characters and white space but the space and the line break, for Arrow's regular expressions.
_ODD = "[\\x00-\\x09\\x0b-\\x1f\\x7f-\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Beyond it characters go through the library's own pre-tokenizer, whose Unicode tables may be of another version.
_LATIN = "ɐ"

# The pre-tokens of the byte-level pre-tokenizer, and its settings in a file for which they hold.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = {
    "normalizer": None,
    "truncation": None,
    "padding": None,
    "post_processor": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False},
}
_pretokens = regex.compile(PRETOKEN)
_open: dict[str, Encoder] = {}


def splits_at_spaces(path: str) -> bool:
    """Whether a vocabulary file asks for what the word-wise way does."""
    with open(path, encoding="utf-8") as f:
        asked = json.load(f)
    for part, wanted in PLAIN.items():
        got = asked.get(part)
        if isinstance(wanted, dict):
            if not isinstance(got, dict) or any(got.get(k, False if v is False else None) != v for k, v in wanted.items()):
                return False
        elif got is not None:
            return False
    return all(t["special"] and not t.get("normalized") for t in asked.get("added_tokens", []))


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return {b: chr(b if b in printable else next(free)) for b in range(256)}


class Encoder:
    """Encodes texts with the vocabulary at `path`; one for each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text that spells a special token is ordinary text
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.characters = byte_characters()
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = np.array(newline, self.kind).tobytes()
        self.by_words = splits_at_spaces(path) and len(newline) == 1

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _pretokens(self, tokens: list[str]) -> dict[str, bytes]:
        """The ids of distinct pre-tokens, by the library's model."""
        mapped = "\n".join(tokens).encode().decode("latin-1").translate(self.characters).split(self.characters[10]) if tokens else []
        return self._modelled(tokens, mapped)

    def _modelled(self, names: list[str], mapped: list[str]) -> dict[str, bytes]:
        encoded = [[x.id for x in self.model.tokenize(m)] for m in mapped]
        data = np.fromiter(chain.from_iterable(encoded), self.kind).tobytes()
        ends = [self.width * n for n in accumulate(map(len, encoded))]
        return {t: data[a:b] for t, a, b in zip(names, [0, *ends], ends, strict=False)}

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces without white space but a leading space."""
        rest = [p for p in pieces if not (p.isascii() or max(p) < _LATIN)]
        out = dict(zip(rest, self._whole(rest), strict=True))
        plain = [p for p in pieces if p not in out]
        tokens = _pretokens.findall("\n".join(plain)) if plain else []
        known = self._pretokens(list({*tokens} - {"\n"}))
        held: list[bytes] = []
        at = 0
        for t in tokens:
            if t == "\n":
                out[plain[at]] = b"".join(held)
                held, at = [], at + 1
            else:
                held.append(known[t])
        if plain:
            out[plain[at]] = b"".join(held)
        return out

    def _spaced(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words after a space. What is all letters is one pre-token, most others are that and a mark."""
        space = self.characters[32]
        letters, marked, other = [], [], []
        for w in words:
            if not w.isascii():
                other.append(w)
            elif w.isalpha():
                letters.append(w)
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                marked.append(w)
            else:
                other.append(w)
        stems = {w[:-1] for w in marked}.difference(letters)
        letters += stems
        out = self._modelled(letters, [space + w for w in letters])
        marks = self._pretokens(list({w[-1] for w in marked}))
        out.update((w, out[w[:-1]] + marks[w[-1]]) for w in marked)
        got = self._pieces([" " + w for w in other])
        out.update((w, got[" " + w]) for w in other)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words after a space, or, where a word begins with a line break, after that.

        The memo has two halves: words are looked for in both and kept in the newer one, which takes the older one's place
        when it is full. So words that come again stay.
        """
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        memo, old = self.memo, self.old
        out = list(map(memo.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        asked, spaced, bare = [], [], []
        for i in new:
            w = words[i]
            got = old.get(w)
            if got is not None:
                out[i] = memo[w] = got
            elif w in ("", "\n"):
                out[i] = memo[w] = self.newline if w else b""
            else:
                asked.append(i)
                (bare if w[0] == "\n" else spaced).append(w)
        ids = self._spaced(spaced)
        rest = self._pieces([w[1:] for w in bare])
        ids.update((w, self.newline + rest[w[1:]]) for w in bare)
        for i in asked:
            w = words[i]
            out[i] = ids[w]
            if len(w) <= LONGEST:
                memo[w] = ids[w]
        return out

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, pa.Array]:
        """(the number of ids, and the ids as little-endian unsigned integers of self.width bytes) of each text.

        A null text counts as empty; end_id follows the ids of each text.
        """
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the collector would go through the memo again and again
        try:
            return self._encode_column(texts, end_id)
        finally:
            if collecting:
                gc.enable()

    def _encode_column(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, pa.Array]:
        n = len(texts)
        texts = texts.cast(pa.large_string()).fill_null("")
        end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.by_words else np.ones(n, bool)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), "\n", " \n"), " ")
        first = np.asarray(split.offsets)
        numbered = split.flatten().dictionary_encode()
        words, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        # a space before white space, or three line breaks in a row, make longer pre-tokens
        place = {w: i for i, w in enumerate(words) if w in ("", "\n")}
        wrong = np.zeros(len(number) + 1, bool)
        wrong[:-1] = number == place.get("", -1)
        wrong[first[:-1]] = False
        line = number == place.get("\n", -1)
        wrong[1:-1] |= line[1:] & line[:-1]
        wrong[first[:-1]] = False
        odd |= np.logical_or.reduceat(wrong, first[:-1]) if n else odd
        del split, numbered, line, wrong
        table = self._words(words)
        # the first words have no space before them; the ids of whole texts take the place of their first word
        heads = [words[i] for i in number[first[:-1]].tolist()]
        bare = self._heads(heads)
        whole = np.flatnonzero(odd)
        direct = dict(zip(whole.tolist(), self._whole(pc.take(texts, pa.array(whole)).to_pylist()), strict=True))
        entries = [*table, *(direct[i] if i in direct else bare[w] for i, w in enumerate(heads)), b"", end]
        nothing, last = len(entries) - 2, len(entries) - 1
        stream = np.empty(len(number) + n, np.int32)
        own = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
        stream[np.arange(len(number), dtype=np.int32) + own] = np.where(odd[own], np.int32(nothing), number)
        stream[first[:-1] + np.arange(n)] = len(table) + np.arange(n)
        stream[first[1:] + np.arange(n)] = last
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // self.width
        ids = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(entries), self.kind))).take(pa.array(stream)).flatten()
        counts = np.add.reduceat(sizes[stream], first[:-1] + np.arange(n)) if n else np.empty(0, np.int64)
        bounds = np.r_[0, np.cumsum(counts)] * self.width
        data = pa.py_buffer(np.ascontiguousarray(ids.to_numpy()))
        return counts, pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), data])

    def _heads(self, words: list[str]) -> dict[str, bytes]:
        return {"": b""} | self._pieces([w for w in dict.fromkeys(words) if w])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        return self.encode_column(pa.array(texts, pa.string()))[1].to_pylist()


def encoder(path: str) -> Encoder:
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def widen(data: bytes, n: int) -> np.ndarray:
    """n ids as unsigned 32-bit integers, from 16 or 32 bits each; their number tells which."""
    return np.frombuffer(data, "<u2").astype("<u4") if len(data) == 2 * n else np.frombuffer(data, "<u4")


def encoded_batch(path: str, end_id: int):
    """For map_chunks: the other columns, n_tokens and ids (of the vocabulary's width), end_id appended to each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids = encoder(path).encode_column(batch.column("text"), end_id)
        carried = [n for n in batch.schema.names if n != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in carried), pa.array(counts, pa.int64()), ids.cast(pa.binary())], names=[*carried, "n_tokens", "ids"])

    return run
