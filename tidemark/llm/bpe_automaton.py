"""BPE encoding and decoding with a compiled deterministic automaton.

Compilation.  The automaton reads *tokens*; it accepts exactly the token
sequences that byte-pair encoding can emit.  It starts as one state that loops
on every base symbol.  Each merge ``u v -> w``, taken in rank order, adds one
gadget: arcs labelled ``w`` are put beside all arcs labelled ``u`` (they leave
the same states), they lead to a new state with the arcs that ``v``'s state has
at that time, and the arc ``v`` is cut from the state reached by ``u`` (that
path is what the merge replaces).  A state is thus named by the token read
last.  The full table would have V x V cells, so a gadget is kept as its three
numbers (when it was added, whose arcs its label and its state copy, which arc
it cuts) and a cell of the table is worked out from them the first time it is
needed, then looked up; the table of filled cells has a fixed size and a cell
that falls out is worked out again.

Encoding.  Every prefix of a word has exactly one accepted path, so the state
after each prefix is single and the path is found left to right, with no
backtracking: at a position in a known state, a trie lists the tokens that
start there and the table says which of them is an arc.  It is done for all
distinct words of a batch at once with array gathers; words longer than
``LONG_WORD`` symbols take the same steps one word at a time.

Decoding emits the label (byte string) of each arc.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

LONG_WORD = 192
WHITE = regex.compile(r"\s+")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Values by pairs of small integers, by open addressing; -1 where a pair has none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = int(np.ceil(np.log2(max(2, len(keys))))) + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.slot(keys, self.shift)
        while len(left):  # each free place goes to one of those that want it
            free = self.key[at] < 0
            put, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.key[put], self.value[put] = keys[won], values[won]
            go = self.key[at] != keys[left]
            left, at = left[go], (at[go] + 1) & self.mask

    @staticmethod
    def slot(key: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        at = self.slot(key, self.shift)
        got = self.key[at]
        out = self.value[at]
        wrong = np.flatnonzero(got != key)
        out[wrong] = -1
        wrong = wrong[got[wrong] >= 0]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            got = self.key[at[wrong]]
            hit = got == key[wrong]
            out[wrong[hit]] = self.value[at[wrong[hit]]]
            wrong = wrong[~hit & (got >= 0)]
        return out


class Automaton:
    """The compiled automaton of one vocabulary file (BPE with a word end)."""

    def __init__(self, path: str, splits_only: bool = False) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.end or model.get("ignore_merges"):
            raise ValueError("a BPE vocabulary with a word end is needed")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        if splits_only:
            return
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._labels(vocab)
        self._compile(vocab, merges)
        self._trie(vocab)

    def _labels(self, vocab: dict[str, int]) -> None:
        self._byte_of = _byte_alphabet()
        n = max([*vocab.values(), *self.special.values()]) + 1
        label = [""] * n
        for t, i in (vocab | self.special).items():
            label[i] = t
        #: what decoding emits for an arc; a vocabulary without a decoder puts blanks between labels
        self.label = pa.array([f"{t} " for t in label], pa.large_string())

    def _compile(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        n = len(self.label)
        self.born = np.full(n, -1, np.int32)  # when the gadget of a token was added; -1: a base symbol
        self.left = np.arange(n, dtype=np.int32)  # its label copies the arcs of this label
        self.right = np.arange(n, dtype=np.int32)  # its state copies the arcs of this state
        cut = np.empty((len(merges), 2), np.int64)
        for rank, (u, v) in enumerate(merges):
            w = vocab[u + v]
            self.born[w], self.left[w], self.right[w] = rank, vocab[u], vocab[v]
            cut[rank] = vocab[u], vocab[v]
        self._cuts = PairTable(cut[:, 0] << 20 | cut[:, 1], np.arange(len(merges), dtype=np.int32))
        self._cell_key = np.full(1 << 21, -1, np.int64)
        self._cell = np.zeros(1 << 21, bool)

    def _work_out(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether label b leaves the state named a, from the gadgets, newest first."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        until = np.full(len(a), np.iinfo(np.int32).max - 1, np.int32)  # gadgets added before this one count
        a, b = a.copy(), b.copy()
        while len(live):
            cut = self._cuts.get(a.astype(np.int64) << 20 | b)
            gone = (cut >= 0) & (cut < until)
            out[live[gone]] = False
            born_a, born_b = self.born[a], self.born[b]
            go = ~gone & ((born_a >= 0) | (born_b >= 0))
            live, a, b, born_a, born_b = live[go], a[go], b[go], born_a[go], born_b[go]
            from_state, from_label = born_a >= born_b, born_b >= born_a
            # a state copies arcs before its gadget's own cut, a label after it
            until = np.where(from_state, born_a, born_b + 1)
            a, b = np.where(from_state, self.right[a], a), np.where(from_label, self.left[b], b)
        return out

    def _trie(self, vocab: dict[str, int]) -> None:
        """Labels as a trie; a word's last byte is the symbol 256 + byte, as its base symbol differs."""
        child: dict[int, int] = {}
        token, nodes = {}, 1
        for t, i in vocab.items():
            ended = t.endswith(self.end) and t != self.end
            symbols = [self._byte_of[c] for c in (t[: -len(self.end)] if ended else t)]
            if ended:
                symbols[-1] += 256
            node = 0
            for x in symbols:
                cell = node << 9 | x
                if cell not in child:
                    child[cell] = nodes
                    nodes += 1
                node = child[cell]
            token[node] = i
        self.child, self.nodes = child, nodes
        self.token = np.full(nodes, -1, np.int32)
        self.token[list(token)] = list(token.values())
        self._children = PairTable(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)))

    def is_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Cells of the transition table; the start's state is -1 and has every arc."""
        key = state.astype(np.int64) << 20 | token
        at = PairTable.slot(key, np.uint64(64 - 21))
        ok = self._cell[at]
        miss = np.flatnonzero((self._cell_key[at] != key) & (state >= 0))
        if len(miss):
            new, where = np.unique(key[miss], return_inverse=True)
            found = self._work_out(new >> 20, new & 0xFFFFF)
            ok[miss] = found[where]
            put = PairTable.slot(new, np.uint64(64 - 21))
            self._cell[put], self._cell_key[put] = found, new
            # two new cells may want one place: what the key says must hold
            self._cell[put] = found[np.searchsorted(new, self._cell_key[put])]
        ok[state < 0] = True
        return ok

    def _one(self, symbols: np.ndarray) -> list[int]:
        """One word of any length."""
        n = len(symbols)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        seq = symbols.tolist()
        child, token = self.child, self.token
        for j in range(n):
            node, found = 0, []
            for e in range(j, n):
                node = child.get(node << 9 | seq[e], -1)
                if node < 0:
                    break
                t = int(token[node])
                if t >= 0 and last[e + 1] < 0:
                    found.append((t, e + 1))
            if found:
                t = np.array([t for t, _ in found])
                for ok, (t, e) in zip(self.is_arc(np.full(len(t), last[j]), t), found, strict=True):
                    if ok:
                        last[e], back[e] = t, j
        out, e = [], n
        while e:
            out.append(last[e])
            e = back[e]
        return out[::-1]

    def encode_words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's ids end."""
        edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        flat = np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].astype(np.int32)
        stop, size = edges[1:] - edges[0], np.diff(edges)
        start = stop - size
        if len(words):
            flat[stop - 1] += 256
        last = np.full(len(flat) + len(words) + 1, -1, np.int32)  # a word's prefix of length j is at start + its number + j
        back = np.zeros(len(last), np.int32)
        shift = np.arange(len(words), dtype=np.int64)
        short = np.flatnonzero(size <= LONG_WORD)
        short = short[np.argsort(-size[short], kind="stable")]
        sizes = size[short]
        j = 0
        while len(short) and (m := int(np.searchsorted(-sizes, -j, "left"))):  # words longer than j
            w = short[:m]
            at = start[w] + j
            s = last[at + shift[w]]
            node, left = np.zeros(m, np.int32), stop[w] - at
            live, k = np.arange(m), 0
            here = at + shift[w]
            while len(live):
                node = self._children.get(node.astype(np.int64) << 9 | flat[at[live] + k])
                good = node >= 0
                live, node = live[good], node[good]
                k += 1
                t = self.token[node]
                hit = np.flatnonzero(t >= 0)
                if len(hit):
                    hit = hit[self.is_arc(s[live[hit]], t[hit])]
                    target = here[live[hit]] + k
                    last[target], back[target] = t[hit], j
                more = left[live] > k
                live, node = live[more], node[more]
            j += 1
        # walk back all short words together
        counts = np.zeros(len(words), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        w, e = short, sizes.astype(np.int64)
        while len(w):
            at = start[w] + shift[w] + e
            steps.append((w, last[at]))
            counts[w] += 1
            e = back[at].astype(np.int64)
            go = e > 0
            w, e = w[go], e[go]
        long = {int(i): self._one(flat[start[i] : stop[i]]) for i in np.flatnonzero(size > LONG_WORD)}
        for i, ids in long.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(words) else 0, np.int32)
        for k, (w, t) in enumerate(steps):
            ids[ends[w] - 1 - k] = t
        for i, seq in long.items():
            ids[ends[i] - len(seq) : ends[i]] = seq
        return ids, ends

    def words_of(self, chunk: str) -> list[str | int]:
        """Pre-split words of a text; special tokens in it become their ids."""
        out: list[str | int] = []
        for part in self.special_split.split(chunk) if self.special_split is not None else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words.findall("".join(c.lower() for c in WHITE.sub(" ", nfc(part))))
        return out

    def decode(self, ids: np.ndarray, stops: np.ndarray) -> pa.Array:
        """The text of each document; ids of all documents lie one after another, stops has n + 1 entries."""
        emitted = self.label.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(emitted.buffers()[1], np.int64)[: len(ids) + 1]
        starts, upto = ends[stops[:-1]], np.maximum(ends[stops[1:]] - 1, ends[stops[:-1]])
        data = emitted.buffers()[2] or pa.py_buffer(b"")
        # the blank after a document's last label is left out, so each document gets its own slice
        size = upto - starts
        flat = np.frombuffer(data, np.uint8)
        keep = np.ones(len(flat), bool)
        keep[ends[stops[1:]][stops[1:] > stops[:-1]] - 1] = False
        return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(flat[keep]))


def nfc(text: str) -> str:
    import unicodedata

    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


@lru_cache(maxsize=2)
def automaton(path: str, splits_only: bool = False) -> Automaton:
    """Compiled once in each Python worker; for splitting alone nothing is compiled."""
    return Automaton(path, splits_only)
