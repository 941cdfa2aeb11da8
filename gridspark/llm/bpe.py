"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token ids; its paths are exactly the token sequences that the merges produce. It starts with one
state where every base symbol loops. The gadget of merge (a, b) -> c gives a's target a copy without b, and every
state that has an arc a a new arc c to b's target. All arcs of one token lead to one state, so that a state is named by
the token read last; it is kept as its parent state, the arcs taken from it and the time of each.

Spelt out by a trie of the tokens it becomes a deterministic automaton over the symbols of a word: a state is the set of
(token read last, place in the trie) that the symbols so far allow, among which one token ends here. Rows of its
transition table are filled in when words first need them, up to a bound in bytes. A word is one transition for each
symbol; its encoding is read back from the tokens that end at each place.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bytes, about, that a task keeps of the transition table and of words with their encodings; beyond, each starts over.
#: Words longer than MEMO_LETTERS bytes are not remembered.
TABLE_BYTES, MEMO_BYTES, MEMO_LETTERS = 64 << 20, 32 << 20, 128
#: The pieces that the vocabulary's pre-tokenizer keeps.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class TokenAutomaton:
    """Deterministic automaton over tokens, compiled merge by merge."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocab
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.dead: set[int] = set()
        made = {a + b for a, b in merges}
        self.born.update((i, -1) for t, i in vocab.items() if t not in made)
        for time, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
        self.end = len(merges)

    def _gadget(self, a: int, b: int, c: int, time: int) -> None:
        if self._arc(a, b, time):
            self.cut[a, b] = time
        else:
            self.dead.add(c)  # no path holds a and then b any more
        self.born[c], self.parts[c] = time, (a, b)

    def _arc(self, state: int, token: int, time: int) -> bool:
        """Whether the state after `state` has an arc `token` when the merges before `time` are in."""
        while True:
            if self.cut.get((state, token), time) < time:
                return False
            added, made = self.born[token], self.born[state]
            if added >= time or token in self.dead:
                return False
            if made > added:  # made from the target of its right part, which had the arc or not
                state, time = self.parts[state][1], made
            elif added >= 0:  # the gadget gave the arc to the states that had the left part's
                token, time = self.parts[token][0], added + 1
            else:
                return True

    def follows(self, state: int, token: int) -> bool:
        return self._arc(state, token, self.end)


class SymbolAutomaton:
    """The deterministic automaton over symbols: bytes, plus 256 for the last one of a word."""

    def __init__(self, tokens: TokenAutomaton, spelling: dict[int, list[int]]):
        self.tokens = tokens
        self.length = {t: len(symbols) for t, symbols in spelling.items()}
        # the trie: children of a node by symbol, and the token that ends at a node
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, symbols in spelling.items():
            at = 0
            for c in symbols:
                below = self.child[at].get(c)
                if below is None:
                    below = self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                at = below
            self.ends[at] = token
        self._clear()

    def _clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.parts: list[tuple] = []  # of each state: pairs of the token read last (-1 at the start) and a trie node
        self.last: list[int] = []  # of each state: the token that ends here
        self.rows: list[dict[int, int]] = []  # the transition table
        self.bytes = 0
        self._state(((-1, 0),), -1)

    def _state(self, parts: tuple, last: int) -> int:
        found = self.number.get(parts)
        if found is None:
            found = self.number[parts] = len(self.parts)
            self.parts.append(parts)
            self.last.append(last)
            self.rows.append({})
            self.bytes += 400 + 100 * len(parts)
        return found

    def _row(self, state: int, symbol: int) -> int:
        """Fills in the transition of a state."""
        parts, last = [], -1
        for before, node in self.parts[state]:
            below = self.child[node].get(symbol)
            if below is not None:
                if self.child[below]:
                    parts.append((before, below))
                token = self.ends[below]
                if last < 0 <= token and (before < 0 or self.tokens.follows(before, token)):
                    last = token
        if last < 0:
            raise ValueError(f"no path for symbol {symbol}")
        parts.append((last, 0))
        if self.bytes > TABLE_BYTES:
            self._clear()
            return self._state(tuple(parts), last)
        found = self.rows[state][symbol] = self._state(tuple(parts), last)
        self.bytes += 80
        return found

    def encode(self, symbols: list[int]) -> list[int]:
        state, ends = 0, []
        for c in symbols:
            following = self.rows[state].get(c)
            state = self._row(state, c) if following is None else following
            ends.append(self.last[state])
        out, i = [], len(symbols)
        while i:
            out.append(ends[i - 1])
            i -= self.length[ends[i - 1]]
        return out[::-1]


class Tokenizer:
    """Encodes and decodes text with a vocabulary file of word-end BPE over byte letters."""

    def __init__(self, spec: str):
        given = json.loads(spec)
        model = given["model"]
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix, byte = model["end_of_word_suffix"] or "", {c: i for i, c in enumerate(byte_letters())}
        tokens, made = TokenAutomaton(ids, merges), {a + b for a, b in merges}
        spelling = {}
        for t, i in ids.items():
            final = bool(suffix) and t.endswith(suffix)
            letters = t[: len(t) - len(suffix)] if final else t
            if i not in tokens.dead and letters and (t in made or len(letters) == 1):
                spelling[i] = [byte[c] for c in letters]
                spelling[i][-1] += 256 if final else 0
        self.automaton = SymbolAutomaton(tokens, spelling)
        self.last = 256 if suffix else 0
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.labels = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    def forget(self) -> None:
        """Frees what was filled in along the way, so that an idle worker holds the compiled merges alone."""
        self.memo.clear()
        self.memo_bytes = 0
        self.automaton._clear()

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word, by the automaton's only path over its bytes."""
        symbols = list(word.encode())
        symbols[-1] += self.last
        return self.automaton.encode(symbols)

    def _word(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            found = array("I", self.encode_word(word)).tobytes()
            if len(found) <= 4 * MEMO_LETTERS:
                if self.memo_bytes > MEMO_BYTES:
                    self.memo.clear()
                    self.memo_bytes = 0
                self.memo[word] = found
                self.memo_bytes += 200 + len(word) + len(found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.splits.split(text) if self.splits and any(t in text for t in self.special) else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower case goes letter by letter
            out.extend(map(self._word, PIECES.findall(part.lower())))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs in order; the vocabulary has no decoder, so a space joins them."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(spec: str) -> Tokenizer:
    return Tokenizer(spec)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _mapped(documents: DataFrame, path: str | None, columns: list[str], schema: str, row) -> DataFrame:
    with open(path or default_path(), encoding="utf-8") as f:
        spec = documents.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, 1.7 MB
    types = documents.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec.value)
        try:
            for batch in batches:
                names = batch.schema.names
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    made = [row(t, x or "") for x in part.column(names.index("text")).to_pylist()]
                    data = {c: part.column(names.index(c)) for c in columns} | {k: [m[k] for m in made] for k in (made[0] if made else {})}
                    yield pa.RecordBatch.from_arrays([pa.array(data[f.name], f.type) if isinstance(data[f.name], list) else data[f.name].cast(f.type) for f in arrow], schema=arrow)
        finally:
            t.forget()

    return documents.select(*columns, "text").mapInArrow(encode, schema)


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded text of each document. Null and empty texts have no ids; repeated rows
    stay; an empty table gives an empty one; other columns are ignored."""

    def row(t: Tokenizer, text: str) -> dict:
        ids = t.encode(text)
        return {"n_tokens": len(ids) // 4, "ids": np.frombuffer(ids, "<u4").astype(np.int32), "decoded": t.decode(ids)}

    return _mapped(documents, path, ["doc_id"], "doc_id long, n_tokens long, ids array<int>, decoded string", row)


def digest_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests of the ids and of the text decoded from them, for each row of documents. Null
    and empty texts have no ids; repeated rows stay; an empty table gives an empty one; other columns are ignored."""

    def row(t: Tokenizer, text: str) -> dict:
        ids = t.encode(text)
        return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(t.decode(ids).encode()).hexdigest()}

    return _mapped(documents, path, ["doc_id"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
