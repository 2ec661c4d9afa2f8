"""Byte-pair encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the right tokenizations. It begins as one state that
every byte leads back to. Each merge ``a b``, in order of rank, adds a gadget: the state behind
``a`` is copied without its ``b`` arc, arcs labelled ``a`` lead to the copy, and every state with an
``a`` arc gains an arc labelled ``ab`` to the state behind ``b``. All arcs with one label lead to one
state, so the copies are kept as differences (parent, missing label, rank), and an arc's presence is
read off a label's and a state's history. Arcs used by words are put in a transition table.

A word is encoded by the one accepted run whose labels spell it, found with the transition table,
longest labels first. Decoding emits the labels.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from vidspark.llm.common import map_rows, text_of
from vidspark.llm.tokens import once, read_vocabulary

# Entries kept per worker; the tables start anew beyond them.
TABLE_ARCS = 600_000
KEPT_WORDS = 250_000
KEPT_LETTERS = 64

# Letters whose classes agree between the two pattern libraries; texts with any other letter are
# split by the tokenizers library itself.
UNCOMMON = re.compile("[^\\x00-\\u052F\\u1E00-\\u206F\\u3000-\\u9FFF\\uAC00-\\uD7A3\\uFF00-\\uFFEF]")


class Automaton:
    """Tokens are numbers ``0..n-1``; ``labels[t]`` is the bytes of token ``t``."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(vocab.values()) + 1
        self.labels = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        # Of a token: the first part of its merge and the merge's number (bytes: -1).
        self.left = [-1] * size
        self.rank = [-1] * size
        # Of a token: the state its arcs lead to. Of a state: what it was copied from and when.
        self.behind = [-1] * size
        self.parent, self.missing, self.made = [-1], [-1], [-1]
        self.arcs: dict[int, bool] = {}
        self.size = size
        for token, i in vocab.items():
            if len(token) == 1:
                self.behind[i] = 0
        for number, (first, second) in enumerate(merges):
            self._merge(number, vocab[first], vocab[second], vocab[first + second])
        self.root = self._trie(vocab)

    def _merge(self, number: int, a: int, b: int, ab: int) -> None:
        if self.behind[a] < 0 or self.behind[b] < 0 or self.behind[ab] >= 0:
            return
        before = self.behind[a]
        if not self._leaves(before, b):
            return
        self.left[ab], self.rank[ab] = a, number
        self.behind[ab] = self.behind[b]
        self.behind[a] = len(self.parent)
        self.parent.append(before)
        self.missing.append(b)
        self.made.append(number)

    def _leaves(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc labelled ``token``.

        A copy has the arcs its origin had at the time, but one; an arc for a merge came to a state
        that had the arc of the merge's first part just then.
        """
        while True:
            rank = self.rank[token]
            while self.made[state] > rank:
                if self.missing[state] == token:
                    return False
                state = self.parent[state]
            if rank < 0:
                return True
            token = self.left[token]

    def _trie(self, vocab: dict[bytes, int]) -> dict:
        root: dict = {}
        for token, i in vocab.items():
            if self.behind[i] < 0:
                continue
            node = root
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = i
        return root

    def arc(self, state: int, token: int) -> bool:
        at = state * self.size + token
        have = self.arcs.get(at)
        if have is None:
            if len(self.arcs) >= TABLE_ARCS:
                self.arcs.clear()
            have = self.arcs[at] = self._leaves(state, token)
        return have

    def encode(self, word: bytes) -> list[int]:
        """The accepted run over ``word``, longest arcs first.

        A prefix has one accepted run at most, so a position is reached once and the search is
        linear in the word, times the length of a token.
        """
        behind, root, size, arcs = self.behind, self.root, self.size, self.arcs
        out: list[int] = []
        ways: list[list[tuple[int, int]]] = []
        n, i, state = len(word), 0, 0
        while i < n:
            way, node, k = [], root, i
            while k < n:
                node = node.get(word[k])
                if node is None:
                    break
                k += 1
                token = node.get(-1)
                if token is not None:
                    way.append((k, token))
            while True:
                while way:
                    k, token = way.pop()
                    have = arcs.get(state * size + token)
                    if have is None:
                        have = self.arc(state, token)
                    if have:
                        break
                else:
                    # No arc leads on: take back the last token.
                    way = ways.pop()
                    out.pop()
                    state = behind[out[-1]] if out else 0
                    continue
                break
            out.append(token)
            ways.append(way)
            state, i = behind[token], k
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs taken, one after the other."""
        return b"".join([self.labels[i] for i in ids])


class Codec:
    """Whole texts: added tokens, pre-splitting, words. One per worker."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        vocab, merges, self.added = read_vocabulary(path)
        self.path = path
        self.automaton = Automaton(vocab, merges)
        for token, i in self.added.items():
            self.automaton.labels += [b""] * (i + 1 - len(self.automaton.labels))
            self.automaton.labels[i] = token.encode()
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        # Two generations, so that frequent words outlive a fresh start.
        self.words: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def splitter(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def split(self, text: str) -> list[str]:
        if UNCOMMON.search(text):
            pre = once(Codec.splitter, self)
            return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def ids(self, text: str) -> list[int]:
        out = []
        for n, part in enumerate(self.special.split(text) if self.special else [text]):
            if n % 2:
                out.append(self.added[part])
            elif part:
                for w in self.split(part):
                    out += self.automaton.encode(w.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")

    def word(self, w: str) -> tuple[int, str, bytes]:
        """Number of ids, ids as text, and decoded bytes of a word."""
        made = self.older.get(w)
        if made is None:
            ids = self.automaton.encode(w.encode("utf-8", "surrogatepass"))
            made = len(ids), ",".join(map(str, ids)), self.automaton.decode(ids)
        if len(w) <= KEPT_LETTERS:
            if len(self.words) >= KEPT_WORDS:
                self.words, self.older = {}, self.words
            self.words[w] = made
        return made

    def parts(self, text: str) -> list[tuple[int, str, bytes]]:
        """What ``word`` gives for each word and added token of a text."""
        out: list[tuple[int, str, bytes]] = []
        make = self.word
        for n, part in enumerate(self.special.split(text) if self.special else [text]):
            if n % 2:
                out.append((1, str(self.added[part]), part.encode()))
            elif part:
                have = self.words
                out += [have[w] if w in have else make(w) for w in self.split(part)]
        return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text (null: none)."""

    def make():
        codec = once(Codec, path)
        return lambda texts: [[codec.ids(t) for t in texts]]

    return map_rows(docs, [text_of(docs)], make, "ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows(ids, …)`` with ``text``, which the ids spell (null ids: empty)."""

    def make():
        codec = once(Codec, path)
        return lambda ids: [[codec.decode(i or []) for i in ids]]

    return map_rows(rows, [rows["ids"]], make, "text string")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: number of ids, digest of the ids and of what they decode to, with ``doc_id``.

    Null and empty texts have no ids. A map over rows: nothing is shuffled, and repeated rows,
    null ids and further columns make no difference.
    """

    def make():
        codec = once(Codec, path)

        def work(texts):
            n, ids, back = [], [], []
            for text in texts:
                parts = codec.parts(text)
                n.append(sum([p[0] for p in parts]))
                ids.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                spelled = b"".join([p[2] for p in parts]).decode("utf-8", "replace").encode()
                back.append(hashlib.sha256(spelled).hexdigest())
            return [n, ids, back]

        return work

    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_rows(ids, [ids["text"]], make, DIGESTS, drop=("text",))
