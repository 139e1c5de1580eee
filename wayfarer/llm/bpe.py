"""Byte-pair encoding by a token automaton.

Compilation starts from the automaton with one state and an arc to it for every byte token, which accepts every
byte sequence, and applies one gadget for each merge (u, v) -> w in order: every path s -u-> p -v-> r gains the
arc s -w-> r, and u is redirected to a copy of p without its v-arc, so that the unmerged spelling is no longer
accepted.  What remains accepts exactly one token path for each word: its encoding.

States are stored as differences.  All arcs of a label lead to one state (that holds at the start, and each gadget
preserves it), so a state is its parent plus one removed arc, and an arc is present unless a removal on the state's
chain hit the arc, or the arc it was derived from, before the derivation.  Arc tables of that form grow with the
number of merges, not with its square; looked-up arcs are kept in a transition table.

Over tokens the automaton is deterministic: a state has at most one arc of a label.  Over bytes several arcs of a state may
spell the next bytes, and one of them at most lies on the accepted path.  Encoding walks the byte trie of the labels and the
transition table together, longest label first, which is nearly always that arc, and else searches with a memory of
positions that lead nowhere.  Transitions are looked up once and then kept in the table.  Decoding emits the labels.
"""

from __future__ import annotations

import gc
import hashlib
import json
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_slices, pick

#: Fixed value: the published pre-tokenization pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

DEAD = -1
#: Entries of one generation of a cache; two generations are held.
CACHE_ENTRIES = 300_000
#: Bytes by which the tokens that may come next are remembered.
WINDOW = 8


def byte_letters() -> dict[str, int]:
    """The published printable alphabet of the vocabulary files: printable Latin-1 stands for itself, the other
    bytes follow from code point 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """labels[t]: bytes of token t.  target[t]: the state that every arc of label t leads to."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int] | None = None):
        letters = byte_letters()
        self.labels: list[bytes] = [b""] * (max([*vocab.values(), *(special or {}).values()]) + 1)
        for token, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in token)
        for token, i in (special or {}).items():
            self.labels[i] = token.encode()
        self.special = dict(special or {})
        self._compile(vocab, merges)
        self.trie: dict = {}
        for i in self.target:
            node = self.trie
            for byte in self.labels[i]:
                node = node.setdefault(byte, {})
            node[-1] = i
        self.table: dict[int, int] = {}
        self.windows: dict[bytes, list[int]] = {}

    def _compile(self, vocab: dict[str, int], merges: list) -> None:
        made: dict[int, tuple[int, int]] = {}  # token -> (gadget that made its arcs, the token whose arcs it follows)
        self.target = {vocab[c]: 0 for c in byte_letters() if c in vocab}
        self.parent, self.removed = [-1], [(-1, -1)]  # of each state; (token, gadget)
        self.made = made
        self.depth = [0]
        for k, pair in enumerate(merges):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if u not in self.target or v not in self.target:
                raise ValueError(f"merge {k} uses a token that no earlier merge makes")
            p = self.target[u]
            if w in self.target or not self._arc(p, v):
                raise ValueError(f"merge {k} never applies: its pair is spelled by an earlier merge")
            made[w] = (k, u)
            self.target[w] = self.target[v]
            self.parent.append(p)
            self.removed.append((v, k))
            self.target[u] = len(self.parent) - 1
        self._removals: dict[int, dict[int, int]] = {}

    def _chain(self, state: int) -> dict[int, int]:
        """token -> gadget of every removal on the state's chain."""
        found: dict[int, int] = {}
        while state > 0:
            token, gadget = self.removed[state]
            found[token] = gadget
            state = self.parent[state]
        return found

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc of this label.  The label's arcs were copied, when made, from those of its
        left part: a removal of that part's arc counts if it came first."""
        line, born = {}, 1 << 60
        while True:
            line[token] = born
            if token not in self.made:
                break
            born, token = self.made[token]
        while state > 0:
            token, gadget = self.removed[state]
            if line.get(token, -1) >= gadget:
                return False
            state = self.parent[state]
        return True

    def step(self, state: int, token: int) -> int:
        """The transition table: the next state or DEAD."""
        key = state << 20 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= 2_000_000:
                self.table.clear()
            found = self.table[key] = self.target[token] if self._fast_arc(state, token) else DEAD
        return found

    def _fast_arc(self, state: int, token: int) -> bool:
        removals = self._removals.get(state)
        if removals is None:
            if len(self._removals) >= 2_000:
                self._removals.clear()
            removals = self._removals[state] = self._chain(state)
        born = 1 << 60
        while True:
            gadget = removals.get(token)
            if gadget is not None and gadget <= born:
                return False
            if token not in self.made:
                return True
            born, token = self.made[token]

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted path whose labels spell the word.  The longest present arc is nearly always the right
        one; where it leads nowhere the search with memory takes over."""
        windows, table, labels, path, state, at = self.windows, self.table.get, self.labels, [], 0, 0
        while at < len(word):
            for token in windows.get(word[at : at + WINDOW]) or self._options(word[at:]):
                onward = table(state << 20 | token)
                if onward is None:
                    onward = self.step(state, token)
                if onward != DEAD:
                    path.append(token)
                    state = onward
                    at += len(labels[token])
                    break
            else:
                return self._search(word)
        return path

    def _options(self, rest: bytes) -> list[int]:
        """Tokens that the bytes begin with, longest first; remembered by a window where none reaches beyond it."""
        node, found, deep = self.trie, [], 0
        for byte in rest:
            node = node.get(byte)
            if node is None:
                break
            deep += 1
            token = node.get(-1)
            if token is not None:
                found.append(token)
        found.reverse()
        if deep < WINDOW or len(rest) <= WINDOW:
            if len(self.windows) >= CACHE_ENTRIES:
                self.windows.clear()
            self.windows[rest[:WINDOW]] = found
        return found

    def _search(self, word: bytes) -> list[int]:
        n, path, choices, at, state, dead = len(word), [], [], 0, 0, set()
        fresh = True
        while at < n:
            if fresh:
                node, options, i = self.trie, [], at
                while i < n:
                    node = node.get(word[i])
                    if node is None:
                        break
                    i += 1
                    if -1 in node:
                        options.append(node[-1])
                choices.append((at, state, options))
            at, state, options = choices[-1]
            fresh = False
            while options:
                token = options.pop()
                after = at + len(self.labels[token])
                onward = self.step(state, token)
                if onward != DEAD and (after, onward) not in dead:
                    path.append(token)
                    at, state, fresh = after, onward, True
                    break
            if not fresh:
                dead.add((at, state))
                choices.pop()
                if not choices:
                    raise ValueError("the vocabulary cannot spell this word")
                path.pop()
        return path


class TwoGenerations:
    """A bounded cache that keeps what is used: full, the young entries become the old ones, and hits bring them back.
    Values are tuples of numbers, which the garbage collector need not watch."""

    def __init__(self):
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def older(self, key: str) -> tuple[int, ...] | None:
        found = self.old.get(key)
        return self.put(key, found) if found else None

    def put(self, key: str, value: tuple[int, ...]) -> tuple[int, ...]:
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class Chunks(dict):
    """Ids of a space and the part that follows it, by the part: a bounded cache of two generations that fills itself."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        found = self.old.get(part) or self.make(" " + part)
        if len(part) < 40:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


class Encoder:
    """Whole texts: special tokens, pre-splitting, and a bounded cache from chunks to their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.automaton = TokenAutomaton(spec["model"]["vocab"], spec["model"]["merges"], special)
        self.words, self.chunks = TwoGenerations(), Chunks(self._split)
        self.split = regex.compile(PATTERN).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # A boundary before a single space is one of the pattern's own, unless that space lies inside or ends a run.
        self.runs = regex.compile(r"\s (?:\s|\Z)").search
        self.names = [str(i) for i in range(len(self.automaton.labels))]

    def word(self, text: str) -> tuple[int, ...]:
        found = self.words.young.get(text) or self.words.older(text)
        return found or self.words.put(text, tuple(self.automaton.encode_word(text.encode("utf-8", "surrogatepass"))))

    def _split(self, text: str) -> tuple[int, ...]:
        return tuple([i for w in self.split(text) for i in self.word(w)])

    def _plain(self, text: str) -> list[int]:
        if ("  " in text or "\n " in text or text.endswith(" ") or not text.isascii()) and self.runs(text):
            return [i for w in self.split(text) for i in self.word(w)]
        head, *rest = text.split(" ")
        out = list(self._split(head))
        out.extend(chain.from_iterable(map(self.chunks.__getitem__, rest)))
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        special = self.automaton.special
        return list(chain.from_iterable([special[s]] if s in special else self._plain(s) for s in self.marks.split(text) if s))

    def decode(self, ids) -> str:
        return b"".join(map(self.automaton.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker: built on first use, then kept, and left out of later garbage collections."""
    built = Encoder(path)
    gc.freeze()
    return built


CODES = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes it again; the columns of CODES, one row per input row.

    A null text is the empty one and has no ids; repeated rows repeat; very long texts are encoded whole; an empty table
    gives no rows; other columns are ignored.
    """

    def rows(part):
        enc = encoder(vocabulary)
        out = {"doc_id": part["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in part["text"]:
            ids = enc.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(enc.names.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest())
        return out

    return map_slices(pick(docs, doc_id=id_col, text=text_col), rows, CODES, _CODES)


IDS = "doc_id bigint, ids array<int>"
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; a null text has no ids, repeated rows repeat, an empty table gives no rows."""

    def rows(part):
        enc = encoder(vocabulary)
        return {"doc_id": part["doc_id"], "ids": [enc.encode(t) for t in part["text"]]}

    return map_slices(pick(docs, doc_id=id_col, text=text_col), rows, IDS, _IDS)


def decode_ids(codes: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row; null ids give the empty text."""

    def rows(part):
        enc = encoder(vocabulary)
        return {"doc_id": part["doc_id"], "text": [enc.decode(i or []) for i in part["ids"]]}

    return map_slices(pick(codes, doc_id=id_col, ids=ids_col), rows, "doc_id bigint, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
