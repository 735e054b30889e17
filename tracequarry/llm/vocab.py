"""Token ids of whole texts by a vocabulary of the tokenizers library, each distinct word encoded once.

Both kinds of vocabulary end a token at white space, so a text's ids are those of its words in a row. Arrow splits the
texts of a step, numbers their distinct words and parts plain ones (Latin letters, then ASCII marks) from their marks, and
numpy strings the words' ids together by these numbers, so Python sees only words that are not plain. What is left is
looked up in a table of Arrow and numpy arrays, some 40 bytes a word. It lives on in the Python worker from task to task, is
cut back to the words of the step when it would hold over MAX_WORDS, and is emptied when no text has come for IDLE seconds,
so that idle workers do not hold it while other stages run; unseen words are encoded by the library, plain ones many to a
call. A text in which words cannot be told apart in this way (runs of white space, or unusual white space, where those make
tokens) is encoded by the library as a whole.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MAX_WORDS = 900_000
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
MARKED = rf"^(?P<core>{LETTERS})(?P<marks>[!-&(-/:-@\[-`{{-~]+)$"
#: Bytes of text to a step (a longer text is a step by itself), and plain words to a call.
STEP_BYTES, JOINED = 16 << 20, 4000
#: Seconds after the last text until the words are forgotten.
IDLE = 10.0


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at the starts, in a row."""
    place = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    place += np.arange(len(place))
    return flat[place]


class _Ids:
    """Ids of words in a row, how many each has, and which words cannot be encoded by themselves."""

    def __init__(self, parts: list[bytes | None]):
        self.flat = np.frombuffer(b"".join(p or b"" for p in parts), "<u4")
        self.sizes = np.fromiter((len(p or b"") // 4 for p in parts), np.int64, len(parts))
        self.alone = np.array([p is None for p in parts], bool)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def take(self, at: np.ndarray) -> _Ids:
        out = _Ids([])
        out.sizes, out.alone = self.sizes[at], self.alone[at]
        out.flat = _runs(self.flat, self.starts()[at], out.sizes)
        return out

    def joined(self, *others: _Ids) -> _Ids:
        out, every = _Ids([]), (self, *others)
        out.flat, out.sizes, out.alone = (np.concatenate([getattr(x, k) for x in every]) for k in ("flat", "sizes", "alone"))
        return out


class _Table:
    """Ids of words that follow `lead`. starts and ends: the ids that begin or end a word of letters, if there are such."""

    def __init__(self, vocabulary: Vocabulary, lead: str, starts: np.ndarray | None, ends: np.ndarray | None):
        self.vocabulary, self.lead, self.starts, self.ends = vocabulary, lead, starts, ends
        self.parted = starts is not None or ends is not None
        self.forget()

    def forget(self) -> None:
        self.known, self.ids = pa.array([], pa.string()), _Ids([])

    def of(self, words: pa.Array) -> _Ids:
        """The ids of each of the words, which are distinct."""
        if not self.parted:
            return self._of(words)
        found = pc.extract_regex(words, MARKED)
        marked = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        cores = pc.if_else(found.is_valid(), found.field("core"), words)
        cores, marks = cores.dictionary_encode(), found.field("marks").take(pa.array(marked)).dictionary_encode()
        ids = self._of(cores.dictionary).joined(_Ids([self.vocabulary.whole(m) for m in marks.dictionary.to_pylist()]))
        # two parts to a word, the second one mostly empty
        at = np.empty((len(words), 2), np.int64)
        at[:, 0], at[:, 1] = cores.indices.to_numpy(), len(ids.sizes)
        at[marked, 1] = len(cores.dictionary) + marks.indices.to_numpy()
        parts = ids.joined(_Ids([b""])).take(at.reshape(-1))
        parts.sizes, parts.alone = parts.sizes.reshape(-1, 2).sum(axis=1), parts.alone.reshape(-1, 2).any(axis=1)
        return parts

    def _of(self, words: pa.Array) -> _Ids:
        place = pc.index_in(words, value_set=self.known)
        seen = place.is_valid().to_numpy(zero_copy_only=False)
        at = place.fill_null(0).to_numpy().astype(np.int64)
        new = words.filter(pa.array(~seen))
        if len(self.known) + len(new) > MAX_WORDS:
            self.known, self.ids = words.filter(pa.array(seen)), self.ids.take(at[seen])
            at[seen] = np.arange(len(self.known))
        if len(new):
            order, ids = self._learned(new)
            rank = np.empty(len(order), np.int64)
            rank[order] = len(self.known) + np.arange(len(order))
            at[~seen] = rank
            self.known, self.ids = pa.concat_arrays([self.known, new.take(pa.array(order))]), self.ids.joined(ids)
        return self.ids.take(at)

    def _learned(self, new: pa.Array) -> tuple[np.ndarray, _Ids]:
        """An order of the words, and their ids in that order."""
        plain = pc.match_substring_regex(new, f"^{LETTERS}$").to_numpy(zero_copy_only=False) if self.parted else np.zeros(len(new), bool)
        order, found = [], []
        every = np.flatnonzero(plain)
        for i in range(0, len(every), JOINED):
            own = every[i : i + JOINED]
            if (ids := self._plain(new.take(pa.array(own)).to_pylist())) is None:
                plain[own] = False
            else:
                order.append(own)
                found.append(ids)
        odd = np.flatnonzero(~plain)
        words = new.take(pa.array(odd)).to_pylist()
        free = [k for k, w in enumerate(words) if self.vocabulary.separate(w)]
        parts: list[bytes | None] = [None] * len(words)
        for k, ids in zip(free, self.vocabulary.wholes([self.lead + words[k] for k in free]), strict=True):
            parts[k] = ids
        return np.concatenate([*order, odd]), _Ids([]).joined(*found, _Ids(parts))

    def _plain(self, cores: list[str]) -> _Ids | None:
        """Ids of words of letters, from one call; None if they cannot be told apart in it."""
        ids = np.array(self.vocabulary.ids("".join(self.lead + c for c in cores)), dtype="<u4")
        first = np.flatnonzero(self.starts[ids]) if self.starts is not None else np.concatenate([[0], np.flatnonzero(self.ends[ids])[:-1] + 1])
        if len(first) != len(cores) or (len(first) and first[0]):
            return None
        out = _Ids([])
        out.flat, out.sizes, out.alone = ids, np.diff(first, append=len(ids)), np.zeros(len(cores), bool)
        return out


class Vocabulary:
    #: What every text follows: nothing, or a space, after which a first word is one like others.
    lead = ""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.library.get_vocab_size()
        names = [self.library.id_to_token(i) or "" for i in range(size)]
        self.marks: dict[str, bytes] = {}
        self.lock, self.timer = threading.Lock(), None
        self.drops_space = sum(n.endswith("</w>") for n in names) > size // 10
        self.lowers = self.drops_space and self.ids("A B É") == self.ids("a b é")
        if self.drops_space:
            ends = np.array([n.endswith("</w>") for n in names])
            self.spaced = _Table(self, " ", None, ends)
        else:
            self.spaced = _Table(self, " ", np.array([n.startswith("Ġ") for n in names]), None)
            newline = self.ids("\n")
            self.on_line = _Table(self, "\n", np.isin(np.arange(size), newline) if len(newline) == 1 else None, None)
            self.first = _Table(self, "", None, None)

    def ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def wholes(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[text] = _packed(self.ids(text))
        return self.marks[text]

    def separate(self, word: str) -> bool:
        """Whether the word's ids do not depend on the white space around it."""
        return self.drops_space or word.split() == [word] and word.isprintable()

    def encode(self, texts: list[str | None] | pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null."""
        if self.timer:
            self.timer.cancel()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        step = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // STEP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            with self.lock:
                found = self._step(texts[a:b])
            yield from found
        self._rest()

    def _rest(self) -> None:
        """Gives back the memory of the last steps now, and that of the words unless more texts come."""
        pa.default_memory_pool().release_unused()
        self.timer = threading.Timer(IDLE, self.forget)
        self.timer.daemon = True
        self.timer.start()

    def forget(self) -> None:
        """Empties the tables of words, which later steps fill again."""
        with self.lock:
            for table in (self.spaced, *(() if self.drops_space else (self.on_line, self.first))):
                table.forget()
            self.marks = {}
        pa.system_memory_pool().release_unused()  # what the C library holds of them

    def _step(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        written = pc.ascii_lower(texts) if self.lowers else texts  # fewer distinct words are then left to learn
        # words that begin a line keep its end before them
        split = pc.split_pattern(pc.replace_substring(written, "\n", " " if self.drops_space else " \n"), " ")
        words, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        bounds, at, names = bounds - bounds[0], words.indices.to_numpy().astype(np.int64), words.dictionary
        if self.drops_space:
            ids = self.spaced.of(names)
        else:
            on_line = pc.starts_with(names, "\n").to_numpy(zero_copy_only=False)
            ids = self.spaced.of(names.filter(pa.array(~on_line))).joined(self.on_line.of(pc.utf8_slice_codeunits(names.filter(pa.array(on_line)), 1)))
            number = np.empty(len(names), np.int64)
            number[np.concatenate([np.flatnonzero(~on_line), np.flatnonzero(on_line)])] = np.arange(len(names))
            heads = pc.take(names, pa.array(at[bounds[:-1]])).dictionary_encode()
            at = number[at]
            if not self.lead:
                at[bounds[:-1]] = heads.indices.to_numpy().astype(np.int64) + len(names)
                ids = ids.joined(self.first.of(heads.dictionary))
        n = ids.sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw, ends = _runs(ids.flat, ids.starts()[at], n).tobytes(), (4 * ends[bounds]).tolist()
        out = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        whole = np.unique(np.searchsorted(bounds, np.flatnonzero(ids.alone[at]), side="right") - 1).tolist()
        for i, found in zip(whole, self.wholes([self.lead + texts[i].as_py() for i in whole]), strict=True):
            out[i] = found
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each file and Python worker."""
    return Vocabulary(path)
