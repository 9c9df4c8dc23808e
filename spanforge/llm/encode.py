"""Exact, cached encoding with public tokenizers.

A tokenizer first splits a text into pieces that it never merges across. Texts of
common Latin characters are split here by the same rule, and a piece's ids are
looked up; only pieces not yet seen go to the library. Any other text goes to it
whole. Caches belong to the worker process and are bounded; the bound affects speed
only.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

PIECES, CHUNKS = 400_000, 500_000
#: A character for which Python and the tokenizers might not agree on letter, digit and white space.
ODD = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """A bounded dict in two generations: what is asked for again stays, the rest goes."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.old = most, {}, {}

    def fill(self, keys: set, make) -> dict:
        """A dict that holds all keys; make gives the values of those not held yet."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        new = keys - self.now.keys()
        if self.old:
            kept = new & self.old.keys()
            self.now.update((k, self.old[k]) for k in kept)
            new -= kept
        new = list(new)
        self.now.update(zip(new, make(new), strict=True))
        return self.now


class Memo(dict):
    """Values of a function, in two generations like Recent; tidy() between batches keeps it bounded."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def tidy(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class JsonEncoder:
    """Ids of the tokenizers library, as bytes of little-endian unsigned 32-bit integers.

    pieces: how the tokenizer splits; lower: whether it first puts texts in lower case.
    """

    def __init__(self, path: str, pieces: str, lower: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split, self.lower = re.compile(pieces).findall, lower
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.piece_ids, self.chunk_ids = Memo(self._of_piece, PIECES), Memo(self._of_chunk, CHUNKS)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, text: str) -> list[str] | None:
        """Words, each with the white space before it, if that is a single space or line feed; else None.

        A space before a word is left out, and only the first word has none.
        """
        if self.lower:
            return text.split()
        if any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")) or text[:1] in " \n" or text[-1] in " \n":
            return None
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if ODD.search(t) or any(s in t for s in self.specials)]
        out: list = [None] * len(texts)
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        plain = [i for i, x in enumerate(out) if x is None]
        for memo in (self.piece_ids, self.chunk_ids):
            memo.tidy()
        get = self.chunk_ids.__getitem__
        for i in plain:
            text = texts[i].lower() if self.lower else texts[i]
            chunks = self._chunks(text)
            if chunks is None:
                out[i] = self._of_pieces(text)
            elif self.lower:
                out[i] = b"".join(map(get, chunks))
            else:
                out[i] = self._of_pieces(chunks.pop(0)) + b"".join(map(get, chunks))
        return out

    def forget(self) -> None:
        for memo in (self.piece_ids, self.chunk_ids):
            memo.clear()
            memo.old = {}

    def _of_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # a single piece
            return self.piece_ids[chunk if self.lower else " " + chunk]
        return self._of_pieces(chunk if self.lower or chunk[:1] == "\n" else " " + chunk)

    def _of_pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.split(text)))

    def _of_piece(self, piece: str) -> bytes:
        signs = piece.replace(" ", SPACE) if piece.isascii() and piece.isprintable() else "".join(map(SIGNS.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()


def _signs() -> list[str]:
    """The printable sign by which byte-level vocabularies write each byte: itself, or the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(others.get(b, b)) for b in range(256)]


SIGNS = _signs()
SPACE = SIGNS[32]


#: How the two JSON tokenizers split a text, for texts without ODD characters.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"


@functools.lru_cache(maxsize=4)
def byte_encoder(path: str) -> JsonEncoder:
    return JsonEncoder(path, BYTE_PIECES, False)


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> JsonEncoder:
    return JsonEncoder(path, WORD_PIECES, True)


#: Chunks of a text that isn't plain words between single spaces: a line feed with the word that follows, a word with all spaces before it, spaces.
RUNS = re.compile("\n[^ \n]*| *[^ \n]+| +")
#: A chunk of more characters than LONG has prefixes inside, at every character.
LONG = 64


class PieceCounter:
    """Token counts of sentencepiece at prefixes, by dynamic programming.

    No piece but runs of the space mark holds that mark after its first character,
    and none holds a line feed, so no merge crosses from a word to a space, or a line feed:
    count(prefix up to chunk i) = count(prefix up to chunk i - 1) + count(chunk i).
    Inside a long chunk, the prefix up to a character is the prefix without its last piece, and that piece:
    the one piece that stays apart from the last piece before it when the library encodes these two.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(len(m))]
        crossing = [p for p in pieces if "\n" in p or ("▁" in p[1:] and p.strip("▁"))]
        if crossing:
            raise ValueError(f"pieces cross chunks: {crossing[:3]}")
        self.pieces = {p for i, p in enumerate(pieces) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))}
        sizes: dict[str, set] = {}
        for p in self.pieces:
            sizes.setdefault(p[-1], {1}).add(len(p))
        self.sizes = {c: sorted(n, reverse=True) for c, n in sizes.items()}  # of pieces that end with c
        self.widest = max(map(len, self.pieces))
        self.counts = Recent(CHUNKS)
        self.ids, self.apart = Memo(self._ids, CHUNKS), Memo(self._apart, CHUNKS)

    def _chunks(self, text: str) -> list[str]:
        """Chunks without the space (the first: without the one that the library puts before a text) at their start; only after a line feed there is none."""
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] == " " or "▁" in text:
            return [w[1:] if w[0] == " " else w for w in RUNS.findall(" " + text.replace("▁", " "))]
        return text.replace("\n", " \n").split(" ")

    def _count(self, chunks: list[str]) -> list[int]:
        found = self.model.encode(chunks, num_threads=1) if chunks else []
        return [len(ids) - (w[:1] == "\n") if w else 1 for w, ids in zip(chunks, found, strict=True)]  # a line feed has no space mark before it

    def _counted(self, texts: list[str]) -> list:
        import numpy as np

        chunks = [self._chunks(t) for t in texts]
        get = self.counts.fill(set().union(*chunks), self._count).__getitem__
        return [(c, np.fromiter(map(get, c), dtype="i8", count=len(c))) for c in chunks]

    def totals(self, texts: list[str]) -> list[int]:
        return [int(n.sum()) for _, n in self._counted(texts)]

    def prefixes(self, texts: list[str]) -> list[tuple]:
        """For each text, the ends (in characters) of its prefixes up to each chunk's end and inside long ones, and
        their token counts (numpy int64); the last is the whole text."""
        import numpy as np

        for memo in (self.ids, self.apart):
            memo.tidy()
        out = []
        for chunks, n in self._counted(texts):
            sizes = np.fromiter(map(len, chunks), dtype="i8", count=len(chunks))
            feeds = np.fromiter((w[:1] == "\n" for w in chunks), dtype="i8", count=len(chunks))
            ends, counts = np.cumsum(sizes + 1 - feeds) - 1, np.cumsum(n)
            at, more = [], []
            for i in np.flatnonzero(sizes > LONG).tolist():
                run = chunks[i][1:] if feeds[i] else "▁" + chunks[i].replace(" ", "▁")
                inside = self._inside(run, int(n[i] - feeds[i]))
                at += [i] * len(inside)
                more += [(ends[i] - len(run) + e, counts[i] - n[i] + feeds[i] + k) for e, k in inside]
            if at:
                ends, counts = np.insert(ends, at, [e for e, _ in more]), np.insert(counts, at, [k for _, k in more])
            first = int(len(ends) > 0 and ends[0] == 0)  # the space mark before a text that starts with a line feed
            out.append((ends[first:], counts[first:]))
        return out

    def _ids(self, text: str) -> list[int]:
        return self.model.encode("\n" + text)[2:]  # without a space mark before it

    def _apart(self, pair: tuple[str, str]) -> bool:
        """Whether the second is one piece (or a character without one) and stays apart from the first."""
        a, b = pair
        return (len(b) == 1 or len(self.ids[b]) == 1) and (not a or self._ids(a + b) == self.ids[a] + self.ids[b])

    def _inside(self, run: str, total: int) -> list[tuple[int, int]]:
        """(characters, tokens) of run's prefixes of 1, 2, ... characters, but the whole; total: tokens of the whole."""
        w, out = self.widest + 1, []
        last, counts = [""] * w, [0] * w  # of the latest prefixes, in turn
        for e in range(1, len(run) + 1):
            for n in self.sizes.get(run[e - 1], (1,)):
                piece = run[e - n : e]
                if n <= e and (n == 1 or piece in self.pieces) and self.apart[last[(e - n) % w], piece]:
                    break
            else:
                counts[len(run) % w] = -1
                break
            last[e % w], counts[e % w] = piece, counts[(e - n) % w] + len(self.ids[piece])
            if e < len(run):
                out.append((e, counts[e % w]))
        if counts[len(run) % w] != total:  # not a model of this kind: each prefix by the library
            return [(e, len(self._ids(run[:e]))) for e in range(1, len(run))]
        return out


@functools.lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


ENCODERS = (byte_encoder, word_encoder, piece_counter)
