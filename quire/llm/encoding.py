"""Token ids of whole texts with the tokenizers library, encoding each distinct chunk of text once per Python worker.

A text is cut only where the tokenizer itself always cuts, so that the ids of the chunks, joined,
are the ids of the text. Ids are below 65536 and travel as little-endian unsigned 16-bit integers.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that touches white space or an end of the text: the byte-level pattern then looks at more than one chunk.
_SPACES = re.compile(r"\s\s")
#: Distinct chunks that a Python worker remembers, over all its tasks; about 300 MB.
REMEMBERED = 1_500_000
#: Where a full stop or comma isn't a chunk of its own: beside other marks, or (byte level) after white space.
_MARKS = re.compile(r"[.,](?:[^\w \n]|_|(?<=[^\w \n][.,])|(?<=_[.,]))")
_MARKS_OR_SPACE = re.compile(r"[.,](?:[^\w \n]|_|(?<=[^\w \n][.,])|(?<=_[.,])|(?<=\s[.,]))")
_STOP, _COMMA, _START = "\x01", "\x02", "\x03"
_OWN = re.compile(r"[\x01-\x03]")
#: What begins a chunk that has no space before it: a line feed, or the start of the text.
_FIRST = ("\n", _START)
#: Texts are taken together up to so many characters.
AT_ONCE = 4_000_000
#: New chunks go to the tokenizer so many at a time as one text, with a mark between them that is an id of its own.
JOINED = 32
_PLAIN = re.compile(r"[^\s\x00\x1c-\x1f]+").fullmatch
_KNOWN: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, byte_level: bool) -> ChunkEncoder:
    """The worker's encoder, with what it remembers from earlier tasks."""
    if (path, byte_level) not in _KNOWN:
        _KNOWN[path, byte_level] = ChunkEncoder(path, byte_level)
    return _KNOWN[path, byte_level]


def marked(t: str) -> str | None:
    """A text with a space before each place where the byte-level pattern always cuts; None where it has to look at the whole text."""
    if not t or t[0].isspace() or t[-1].isspace() or _SPACES.search(t) or _OWN.search(t):
        return None
    if t[0] not in ".," and not _MARKS_OR_SPACE.search(t):
        t = t.replace(".", " " + _STOP).replace(",", " " + _COMMA)
    return _START + t.replace("\n", " \n")


def texts_of(chunk: str) -> str:
    """The text of a chunk between two spaces of marked()."""
    if chunk[0] in _FIRST:
        return chunk if chunk[0] == "\n" else chunk[1:]
    return chunk.replace(_STOP, ".").replace(_COMMA, ",") if chunk[0] in (_STOP, _COMMA) else " " + chunk


def chunked(texts: list[str], lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks between spaces, the places of all chunks among them, and where each text's chunks begin (and the last one's end)."""
    if not texts:
        return [], np.zeros(0, np.int32), np.zeros(1, np.int32)
    rows = pa.array(texts, pa.string())
    lists = pc.split_pattern(pc.ascii_lower(rows) if lower else rows, " ")
    found = lists.values.dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), lists.offsets.to_numpy()


class ChunkEncoder:
    """encode(texts) -> one bytes object of 16-bit ids per text; a null text is empty.

    byte_level: a chunk is a word with the single space before it, a line feed between two words, or
    a lone full stop or comma with what follows it up to the next space.
    Otherwise the tokenizer drops white space, and a chunk is what lies between spaces, line feeds
    and lone full stops and commas.
    """

    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer, self.byte_level = Tokenizer.from_file(path), byte_level
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.seen: dict[str, bytes] = {}
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.feed = self._ids(["\n"])[0] if byte_level else b""
        # Between line feeds, or between lone NULs, the tokenizer cuts in any case.
        self.mark = "\n" if byte_level else " \x00 "
        (self.mark_id,) = np.frombuffer(self._ids([self.mark])[0], "<u2")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_joined(self, texts: list[str]) -> list[bytes]:
        """_ids of texts that hold neither white space (but for a single space at the start) nor the mark."""
        out: list[bytes] = []
        groups = [texts[i : i + JOINED] for i in range(0, len(texts), JOINED)]
        for group, joined in zip(groups, self._ids([self.mark.join(g) for g in groups]), strict=True):
            ends = (2 * np.flatnonzero(np.frombuffer(joined, "<u2") == self.mark_id)).tolist()
            if len(ends) != len(group) - 1:
                raise ValueError("the mark isn't an id of its own")
            out += [joined[s:e] for s, e in zip([0, *(e + 2 for e in ends)], [*ends, len(joined)], strict=True)]
        return out

    def _text(self, chunk: str) -> str:
        """The text of a chunk, without the line feed or start of text before it."""
        if not self.byte_level:
            return chunk
        return chunk[1:] if chunk[0] in _FIRST else texts_of(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks that are new to the worker."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        plain, odd = [], []
        for x in chunks:
            (plain if _PLAIN(x, 1 if x[:1] in _FIRST else 0) else odd).append(x)
        for new, ids in ((plain, self._ids_joined), (odd, self._ids)):
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.seen.update(zip(part, ids([self._text(x) for x in part]), strict=True))
        if self.byte_level:
            self.seen.update((x, self.feed + self.seen[x]) for new in (plain, odd) for x in new if x[0] == "\n")

    @staticmethod
    def _apart(t: str) -> str:
        if not _MARKS.search(t):
            t = t.replace(".", " . ").replace(",", " , ")
        return t.replace("\n", " ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out, a, chars = [], 0, 0
        for b, t in enumerate(texts, 1):
            chars += len(t or "")
            if chars >= AT_ONCE or b == len(texts):
                out += self._encode(texts[a:b])
                a, chars = b, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.byte_level:
            return self._chunked([self._apart(t or "") for t in texts])
        texts = [t or "" for t in texts]
        cuts = [marked(t) for t in texts]
        rest = iter(self._ids([t for t, c in zip(texts, cuts, strict=True) if c is None and t]))
        cut = iter(self._chunked([c for c in cuts if c is not None]))
        return [b"" if not t else next(rest) if c is None else next(cut) for t, c in zip(texts, cuts, strict=True)]

    def _chunked(self, texts: list[str]) -> list[bytes]:
        """Chunks lie between spaces: distinct ones are found by Arrow, and ids are laid out by places among them."""
        if not texts:
            return []
        # A tokenizer that lower-cases has the same ids for A-Z and a-z.
        chunks, which, ends = chunked(texts, self.lowers)
        codes = list(map(self.seen.get, chunks))
        if new := [x for x, ids in zip(chunks, codes, strict=True) if ids is None]:
            self._learn(new)
            codes = [ids if ids is not None else self.seen[x] for x, ids in zip(chunks, codes, strict=True)]
        flat = np.frombuffer(b"".join(codes), "<u2")
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 2
        start = np.cumsum(size) - size
        n = size[which]
        end = np.cumsum(n)
        raw = flat[np.repeat(start[which] - (end - n), n) + np.arange(end[-1])].tobytes()
        at = np.append(0, 2 * end)[ends].tolist()
        return [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
