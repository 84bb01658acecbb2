"""Encoding whole texts with the tokenizers library, quickly.

Both vocabularies used here split text before merging, and never across a single space or newline
between other characters. So a text is encoded chunk by chunk, each distinct chunk once, and
the ids are gathered by array indexing. Letters and the marks after them are parted as well, so a chunk that ends in marks
is put together from its letters and a small table of such ends. Where white space tells (spaced), a text with any other white space is
encoded whole; so is one that may hold the literal of a special token, which the library's plain call turns into that token's id. The
chunk table is emptied when it reaches ``CHUNKS`` entries, which bounds memory and changes no result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np

CHUNKS = 1_200_000
#: ASCII characters that are neither letters, digits nor white space. A run of them is one piece for both vocabularies.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: What Python splits at and the libraries don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: ASCII white space but for the space and the newline.
OTHER_WHITE = "\t\x0b\x0c\r" + SEPARATORS


def _ramp(size: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)


class Encoder:
    """ids of texts, by a file of the tokenizers library. spaced: chunks carry the space before them (byte-level BPE)."""

    def __init__(self, path: str, spaced: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: How the literals of special tokens begin; a text with such a beginning is never cut.
        self.marks = sorted({t.content[:2].lower() for t in self.model.get_added_tokens_decoder().values()})
        self.spaced = spaced
        self.opens = np.zeros(self.model.get_vocab_size() + 1, bool)
        if spaced:  # tokens that begin with the space
            self.opens[[i for t, i in self.model.get_vocab().items() if t.startswith("\u0120")]] = True
        else:
            self.bar = np.array(self.model.encode("|", add_special_tokens=False).ids)
        #: ids of runs of marks that end a chunk.
        self.ends_in: dict[str, np.ndarray] = {"": np.zeros(0, np.uint32)}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        if n + len(chunks) + 1 > len(self.ends):
            self.ends = np.resize(self.ends, 2 * (n + len(chunks) + 1))
        at = int(self.ends[n])
        self.ends[n + 1 : n + 1 + len(chunks)] = at + np.cumsum(sizes)
        if at + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (at + len(ids)))
        self.flat[at : at + len(ids)] = ids
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _base(self, chunk: str) -> tuple[str, str]:
        """A chunk of letters and ASCII marks after them as (letters, marks): both vocabularies split there. Otherwise (chunk, "").

        Letters beyond ASCII must be letters still once they are composed and lower-cased: another mark would join the run.
        """
        low = chunk.lower() if not self.spaced and chunk.isascii() else chunk
        head = low.rstrip(MARKS)
        if len(head) < len(low) and head.isalpha() and (head.isascii() or max(head) < "\u0250" and unicodedata.normalize("NFC", head).lower().isalpha()):
            return head, low[len(head) :]
        return low, ""

    def _learn(self, chunks: list[str]) -> None:
        """Learns bases first, then puts chunks together from them."""
        parts = [self._base(c) for c in chunks]
        self._encode_new(list({b: None for b, _ in parts if b not in self.known}))
        rest = [(c, b, p) for c, (b, p) in zip(chunks, parts, strict=True) if c not in self.known]
        if rest:
            for p in {p for _, _, p in rest} - self.ends_in.keys():
                if len(self.ends_in) > 10_000:
                    self.ends_in = {"": self.ends_in[""]}
                self.ends_in[p] = self._ids(p)
            extra = [self.ends_in[p] if p in self.ends_in else self._ids(p) for _, _, p in rest]
            more = np.fromiter(map(len, extra), np.int64, len(extra))
            i = np.array([self.known[b] for _, b, _ in rest])
            first, size = self.ends[i], self.ends[i + 1] - self.ends[i]
            total = np.append(0, np.cumsum(size + more))
            ids = np.zeros(total[-1], np.uint32)
            ids[np.repeat(total[:-1], size) + _ramp(size)] = self.flat[np.repeat(first, size) + _ramp(size)]
            ids[np.repeat(total[1:] - more, more) + _ramp(more)] = np.concatenate(extra)
            self._add([c for c, _, _ in rest], ids, size + more)

    def _encode_new(self, chunks: list[str]) -> None:
        """Many chunks are encoded as one text, then told apart by the token that opens or separates them."""
        alone = [c for c in chunks if c[0] == "\n"] if self.spaced else [c for c in chunks if "|" in c]
        held = set(alone)
        many = [c for c in chunks if c not in held]
        for k in range(0, len(many), 2048):
            part = many[k : k + 2048]
            if self.spaced:
                ids = self._ids(" " + " ".join(part))
                first = np.flatnonzero(self.opens[ids])
                sizes = np.diff(np.append(first, len(ids)))
            else:
                ids = self._ids(" | ".join(part) + " |")
                end = np.flatnonzero(ids == self.bar[0])
                sizes = np.diff(np.append(-1, end)) - 1
                ids = ids[ids != self.bar[0]]
            if len(sizes) == len(part):
                self._add(part, ids, sizes)
            else:
                alone += part
        for c in alone:
            ids = self._ids((c[2:] if c[:2] == "\n\n" else c if c[0] == "\n" else " " + c) if self.spaced else c)
            self._add([c], ids, np.array([len(ids)]))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _chunks(self, text: str) -> list[str] | None:
        """Chunks of a text: where white space is dropped its words; else those of a text whose white space is single spaces and
        newlines between other characters. None if it must be encoded whole."""
        if any(m in (text if m.upper() == m else text.lower()) for m in self.marks):
            return None
        if not self.spaced:
            return None if any(c in text for c in SEPARATORS) else text.split()
        out = text.replace("\n", " \n").split(" ")
        if "" in out or "\n" in out or (any(c in text for c in OTHER_WHITE) if text.isascii() else len(text.split()) != len(out)):
            return None
        out[0] = "\n\n" + out[0]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        at, chunks, counts = [], [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            c = self._chunks(t)
            if c is None:
                out[k] = self.whole(t)
                continue
            at.append(k)
            counts.append(len(c))
            chunks += c
        if not chunks:
            return out
        if len(self.known) > CHUNKS:
            self._clear()
        i = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(i < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys([chunks[k] for k in new])))
            i[new] = [self.known[chunks[k]] for k in new]
        first = self.ends[i]
        size = self.ends[i + 1] - first
        total = np.zeros(len(i) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.flat[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        edges = total[np.concatenate([[0], np.cumsum(counts)])]
        for k, a, b in zip(at, edges[:-1], edges[1:], strict=True):
            out[k] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder a Python worker: what a task has learned serves the next one."""
    return Encoder(path, spaced)


def release() -> None:
    """Gives back the encoders that earlier tasks left in this Python worker."""
    encoder.cache_clear()
