"""Ids of whole texts, by way of the distinct words of a batch.

A text is cut at ASCII white space, which no token crosses.  Arrow's kernels do
the cutting and find the distinct pieces; only distinct words are encoded (by
the automaton or by the tokenizers library), and the ids of a text are gathered
from them.  A batch holds ``BATCH_BYTES`` of text, so memory does not grow with
the partition; a text longer than that is a batch of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.bpe_automaton import Automaton, automaton

BATCH_BYTES = 8 << 20
#: Letters that Unicode normalization leaves alone and that have one lower-case letter each.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def give_back() -> None:
    """Returns freed memory to the system, so that workers which live on do not hold their largest batch."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches(columns: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text."""
    for b in columns:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < len(size):
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
            to = max(at + 1, to)
            # taken, not sliced: some of Arrow's string kernels go wrong on what others make of a slice
            yield b if to - at == len(size) else b.take(pa.array(np.arange(at, to)))
            at = to
            give_back()


class Known:
    """Ids of strings seen before: a pool, and where in it each string's ids lie. At most ``most`` strings are kept."""

    def __init__(self, most: int) -> None:
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.strings, self.pool = pa.array([], pa.large_string()), np.empty(0, np.int32)
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, strings: pa.LargeStringArray, encode: Callable[[pa.LargeStringArray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where strings, all different, are among the known ones; ``encode`` gives pool, first and size of those that are new."""
        at = pc.index_in(strings, value_set=self.strings)
        if len(self.strings) + at.null_count > self.most:
            self._forget()
            at = pa.nulls(len(strings), pa.int32())
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = strings.take(pa.array(new))
            pool, first, size = encode(fresh)
            place[new] = len(self.strings) + np.arange(len(new))
            self.strings = pa.concat_arrays([self.strings, fresh])
            self.first, self.size = np.concatenate([self.first, len(self.pool) + first]), np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, pool])
        return place


class LibraryWords:
    """Encodes distinct, already split words with the tokenizers library's model of a vocabulary file."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        self.whole = whole
        self.model = Tokenizer(whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        end = whole.model.end_of_word_suffix
        vocab = whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end)]] = True

    def encode_words(self, words: pa.LargeStringArray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """As Automaton.encode_words; the last id of a word, and no other, carries the word end."""
        texts = words.to_pylist()
        found = self.model.encode_batch_fast([" ".join(texts[k : k + step]) for k in range(0, len(texts), step)], add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, np.int32) for e in found]) if found else np.empty(0, np.int32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(texts):
            raise ValueError("a word without exactly one word end")
        return ids, stops


def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[first[i] : first[i] + size[i]] for all i, one after another."""
    stops = np.cumsum(size)
    at = np.arange(int(stops[-1]) if len(stops) else 0, dtype=np.int64)
    return pool[at + np.repeat(first - (stops - size), size)]


class TextEncoder:
    def __init__(self, path: str, library: bool) -> None:
        self.split: Automaton = automaton(path, library)
        self.words = LibraryWords(path) if library else self.split
        self.marked = self.split.words.pattern  # the vocabulary's own splitting pattern
        import regex

        self.with_breaks = regex.compile(r"\n|" + self.marked)
        # ids of the last pieces and words are kept for the batches that follow
        self.known_chunks, self.known_words = Known(1 << 20), Known(1 << 19)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and n + 1 places where they begin and end. Null: no ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        pieces = pc.ascii_split_whitespace(texts)
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.flatten()
        codes = flat.dictionary_encode()
        chunk_of = codes.indices.to_numpy()
        if not len(chunk_of):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        known = self.known_chunks
        place = known.places(codes.dictionary.cast(pa.large_string()), self._chunks)[chunk_of]
        counts = known.size[place]
        ids = _gather(known.pool, known.first[place], counts)
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ids, edges[offsets - offsets[0]]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: a pool, and where in it each piece's ids lie."""
        n = len(chunks)
        plain = pc.match_substring_regex(chunks, rf"^[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        latin = pc.match_substring_regex(chunks, rf"^[!-~{LETTERS}]+$").to_numpy(zero_copy_only=False) & ~plain
        latin &= ~pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
        where_plain, where_latin, other = np.flatnonzero(plain), np.flatnonzero(latin), np.flatnonzero(~plain & ~latin)
        parts = [pc.utf8_lower(chunks.take(pa.array(where_plain)))]
        n_words = np.zeros(n, np.int64)
        n_words[where_plain] = 1
        order = [where_plain]
        if len(where_latin):
            lines = "\n".join(pc.utf8_lower(chunks.take(pa.array(where_latin))).to_pylist())
            found = pa.array(self.with_breaks.findall(lines), pa.large_string())
            breaks = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(breaks)
            edges = np.concatenate([[-1], cuts, [len(found)]])
            n_words[where_latin] = np.diff(edges) - 1
            parts.append(found.filter(pa.array(~breaks)))
            order.append(where_latin)
        special: list[tuple[int, int]] = []  # place among the words, id
        if len(other):
            words: list[str] = []
            at = sum(map(len, parts))
            for k, chunk in zip(other.tolist(), chunks.take(pa.array(other)).to_pylist(), strict=True):
                got = self.split.words_of(chunk)
                special += [(at + len(words) + j, x) for j, x in enumerate(got) if isinstance(x, int)]
                words += ["" if isinstance(x, int) else x for x in got]
                n_words[k] = len(got)
            parts.append(pa.array(words, pa.large_string()))
            order.append(other)
        codes = pa.concat_arrays(parts).dictionary_encode()
        distinct = codes.dictionary
        word_of = codes.indices.to_numpy().astype(np.int64)
        real = np.flatnonzero(pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False))
        known = self.known_words
        at = known.places(pa.concat_arrays([distinct.take(pa.array(real)).cast(pa.large_string())]), self._words)
        ids, first, size = known.pool, np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        first[real], size[real] = known.first[at], known.size[at]
        word_first, word_size = first[word_of], size[word_of]
        if special:
            place = np.array([p for p, _ in special])
            word_first[place], word_size[place] = len(ids) + np.arange(len(special)), 1
            ids = np.concatenate([ids, np.array([x for _, x in special], np.int32)])
        pool = _gather(ids, word_first, word_size)
        # words lie by piece in the order plain, latin, other
        by = np.concatenate(order)
        edges = np.concatenate([[0], np.cumsum(word_size)])
        upto = np.cumsum(n_words[by])
        chunk_first, chunk_size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        chunk_first[by] = edges[upto - n_words[by]]
        chunk_size[by] = edges[upto] - chunk_first[by]
        return pool, chunk_first, chunk_size


    def _words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, stops = self.words.encode_words(words)
        first = np.concatenate([[0], stops[:-1]]) if len(stops) else np.empty(0, np.int64)
        return ids, first, stops - first


@lru_cache(maxsize=4)
def encoder(path: str, library: bool) -> TextEncoder:
    """One in each Python worker."""
    return TextEncoder(path, library)
