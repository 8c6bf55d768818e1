"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept per worker; beyond it the memory is emptied, which costs time and changes no result.
REMEMBERED = 600_000
#: Words encoded in one go, and chunks given to the library at once: its working memory is about 1 kB per word.
TOGETHER = 100
AT_ONCE = 5_000
#: Bytes of texts whose chunks are looked up together: temporary arrays take about 20 bytes per byte.
LOOKED_UP = 1 << 20
#: Words of letters below this are letters in every version of Unicode, and stand alone in lower-casing and composing.
LATIN_END = "\u0250"
WORD_END = "</w>"

_ENCODERS: dict[str, Encoder] = {}
#: Marks that are cut from the end of a chunk (the apostrophe is not one: it may begin an ending of its own).
_TAIL = b".,;:!?|$#&*%"
#: Two signs between the letters, and the I with a dot, whose lower case ends in a combining dot.
_NO_LETTERS = frozenset("×÷İ".encode()[i : i + 2] for i in (0, 2, 4))
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _ends_in_letter(chunk: bytes) -> bool:
    """An ASCII letter, or one of U+00C0 to U+023F (two bytes) that is a letter in lower case too."""
    if not chunk:
        return False
    if chunk[-1] in _LETTERS:
        return True
    return len(chunk) > 1 and 0xC3 <= chunk[-2] <= 0xC8 and chunk[-2:] not in _NO_LETTERS


#: What the file of a vocabulary must say for its texts to be encoded in chunks. Fixed values.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def _in_chunks(description: dict) -> bool:
    """Whether white space parts the tokens and is dropped, and texts are lower-cased, as a vocabulary's file says."""
    normalizer, split = description.get("normalizer") or {}, description.get("pre_tokenizer") or {}
    parts = split.get("pretokenizers") or [{}]
    rules = [normalizer.get("normalizers") == _NORMALIZERS, len(parts) == 2, parts[0].get("pattern") == _WORDS]
    rules += [parts[0].get("behavior") == "Removed", parts[0].get("invert") is True, parts[-1].get("type") == "ByteLevel"]
    rules += [not parts[-1].get("add_prefix_space"), not parts[-1].get("use_regex"), description.get("post_processor") is None]
    return all(rules)


class Encoder:
    """Encodes white-space separated chunks and remembers their ids.

    Holds for vocabularies whose pre-tokenizer never joins characters across white space and drops it, and whose
    normalizer lower-cases: then the ids of a text are those of its chunks, one after the other. Nothing else of
    the library's work is taken over; every chunk's ids come from the library. Whether a vocabulary is of this kind is read
    from its file; the texts of any other go to the library whole.

    A lower-case word of Latin letters is its own normal form and its own pre-token. Such words go to the same model
    by hundreds, parted by blanks alone; the vocabulary's word ends tell their ids apart. A vocabulary without word ends,
    or one that does not pass the trial, is asked chunk by chunk.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = _in_chunks(json.loads(self.tokenizer.to_str()))
        self.known: dict[bytes, bytes] = {}
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        trial = [w.encode() for w in ("a", "trial", "größe", "über", "ñandú", "zzyzx", "straße", "œuvre")]
        self.has_ends = self._together(trial) == [self._apart([w])[0] for w in trial]

    def _alone(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _apart(self, chunks: list[bytes]) -> list[bytes]:
        return self._alone([chunk.decode() for chunk in chunks])

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words; empty if the word ends do not tell them apart."""
        out: list[bytes] = []
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        joined = [b" ".join(g).decode() for g in groups]
        for group, e in zip(groups, self.words.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(group) or stops[-1] != len(ids):
                return []
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def _ask(self, chunks: list[bytes]) -> None:
        """Remember the ids of chunks that the library has not been asked for."""
        plain, other = [], []
        for chunk in chunks:
            if chunk.isascii():
                easy = chunk.isalpha() and chunk.islower()
            else:
                text = chunk.decode()
                easy = text.isalpha() and max(text) < LATIN_END and text == text.lower()
            (plain if easy else other).append(chunk)
        if not self.has_ends:
            plain, other = [], chunks
        for todo, encode in ((plain, self._together), (other, self._apart)):
            for i in range(0, len(todo), AT_ONCE):
                part = todo[i : i + AT_ONCE]
                self.known.update(zip(part, encode(part) or self._apart(part), strict=True))

    def _encode(self, chunks: set[bytes]) -> None:
        """Remember the ids of new chunks. A letter and the marks after it are always parted, so ``word.`` is ``word`` and ``.``."""
        known = self.known
        ask: set[bytes] = set()
        split, cores, tails = [], [], []
        for chunk in chunks:
            core = chunk.rstrip(_TAIL) if chunk[-1] in _TAIL else chunk
            if core is chunk or not _ends_in_letter(core):
                ask.add(chunk)
            else:
                split.append(chunk)
                cores.append(core)
                tails.append(chunk[len(core) :])
        ask.update(cores)
        ask.update(tails)
        self._ask(list(ask.difference(known)))
        for chunk, core, tail in zip(split, cores, tails, strict=True):
            known[chunk] = known[core] + known[tail]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; NULL is empty."""
        if not self.chunks:
            return self._alone([text or "" for text in texts])
        out: list[bytes] = []
        raws: list[bytes] = []
        weight = 0
        for text in texts:
            text = text or ""
            raw = text.encode()
            # Lower-casing first saves look-ups; it may come before the library's own only where no character is composed anew.
            if b"<|" not in raw:
                if text.isascii():
                    raw = raw.lower()
                elif unicodedata.is_normalized("NFC", text):
                    low = raw.lower()
                    raw = low if unicodedata.is_normalized("NFC", low.decode()) else raw
            raws.append(raw)
            weight += len(raw)
            if weight >= LOOKED_UP:
                out += self._looked_up(raws)
                raws, weight = [], 0
        return out + self._looked_up(raws)

    def _looked_up(self, raws: list[bytes]) -> list[bytes]:
        """Ids of some texts. Each distinct chunk is looked up once; white space at the ends of a text leaves an empty one."""
        parts = pc.ascii_split_whitespace(pa.array(raws, pa.binary()).cast(pa.string()))
        coded = parts.values.dictionary_encode()
        chunks, place = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        known[b""] = b""
        new = {chunk for chunk in chunks if chunk not in known}
        if new:
            self._encode(new)
        found = [known[chunk] for chunk in chunks]
        size = np.array([len(ids) // 4 for ids in found], np.int64)
        first, n = np.cumsum(size) - size, size[place]
        stop = np.concatenate([[0], np.cumsum(n)])
        flat = np.frombuffer(b"".join(found), "<u4")
        ids = flat[np.repeat(first[place] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
        ends = (4 * stop[parts.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
