"""Token ids of whole texts, word by word, with a bounded memory of words already encoded.

Both vocabularies split a text before the merges, and no part that they make ever holds a character that is
not white space followed by white space. So a text may be cut before any space, line feed, tab or
carriage return that follows such a character, and the ids of the pieces in a row are the ids of the
text. The text of a special token is a piece of its own, as in the library.

Most pieces are a word of Latin letters with some punctuation after it. What the library's pre-tokenizer makes of these
is known (checked against it when a file is opened), so they go to the library's model part by part; all
others go through the whole library. A batch of texts is cut, its pieces numbered and divided into words and punctuation, and the ids put in place by
Arrow's kernels; Python sees each different word of a batch once, whatever its case (for vocabularies that lower it) and the punctuation after it.
"""

from __future__ import annotations

import json
import os
import re

#: White space beyond space, line feed, tab and carriage return, by any of the libraries' rules (fixed values).
UNUSUAL_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u180e\u200b\ufeff"
PIECES = re.compile(rf"(?<=[^ \n\t\r{UNUSUAL_SPACE}])(?=[ \n\t\r])")
#: White space before it, Latin letters whose case and form all Unicode versions agree on, punctuation without the apostrophe of contractions.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
#: A key (see ``_raw``) of such a piece.
SIMPLE = rf"(?P<lead>\r[ \n]?|\n)?(?P<word>[{LETTERS}]+)(?P<rest>[!\"#$%&()*+,./:;<=>?@\[\\\]^_`{{|}}~-]*)"
SIMPLE_KEY = re.compile(SIMPLE)
SPACE, LINE = "\u0120", "\u010a"  # how byte-level vocabularies write them
PROBES = (" word", " Straße,", "\nÉa", "Zug###", " a.", "\nThe-", " ÀB!?", "x", " ſŁn&&&")
KNOWN_WORDS, KNOWN_PARTS = 400_000, 400_000
TOGETHER = 200
FEW, KNOWN_FEW = 2000, 100_000  # for fewer pieces Arrow's kernels cost more than they save


class WordEncoder:
    """Encodes texts to little-endian ids of ``width`` bytes.

    Two generations of at most ``known`` words and pieces each are kept (more only if one batch has more): when the younger one is full it
    becomes the older one, so frequent ones stay and memory is bounded.
    """

    def __init__(self, path: str, width: int = 4, known: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from tokenizers import Tokenizer

        self.np, self.pa, self.pc, self.width, self.known = np, pa, pc, width, known
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.dtype = np.dtype(f"<u{width}")
        # a special token between two pieces separates them in one call for many pieces
        self.mark = next(reversed(self.special), None)
        self.mark_id = self.special.get(self.mark)
        self.model = self.tokenizer.model
        settings = json.loads(self.tokenizer.to_str())
        self.lower = settings["normalizer"] is not None
        self.bytes_of = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.shown = str.maketrans({chr(b): c for c, b in byte_of_char().items()})
        self.parts: dict[str, bytes] = {}
        self.few: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        letters = "".join(re.findall(f"[{LETTERS}]", "".join(map(chr, range(0x180)))))
        self.simple = pc.utf8_lower(letters).as_py() == letters.lower()
        probes, right = ["\r" + p for p in PROBES], [self._ids(p) for p in PROBES]
        if self.simple and not self._few(probes) == self._many(pa.array(probes, pa.large_string())).to_pylist() == right:
            self.simple, self.young, self.few = False, {}, {}

    def _ids(self, text: str) -> bytes:
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= KNOWN_PARTS:
                self.parts.clear()
            bytes_of = self.bytes_of
            found = self.parts[part] = b"".join([bytes_of[t.id] for t in self.model.tokenize(part)])
        return found

    def _word(self, word: str) -> bytes:
        """Ids of Latin letters from the model alone; a space before them counts."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.shown)
        elif word[0] == " ":
            word = SPACE + word[1:]
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in self.model.tokenize(word)])

    def _learn_words(self, words: list[str]) -> list[bytes]:
        return list(map(self._word, words))

    def _learn(self, keys: list[str]) -> list[bytes]:
        """Ids of new pieces through the library, in groups that a special token divides."""
        raw = [self._raw(k) for k in keys]
        np, w = self.np, self.width
        if self.mark is None:
            return list(map(self._ids, raw))
        groups = [raw[i : i + TOGETHER] for i in range(0, len(raw), TOGETHER)]
        found = []
        for enc in self.tokenizer.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False):
            ids = np.array(enc.ids, np.uint32)
            cut, data = np.flatnonzero(ids == self.mark_id) * w, ids.astype(self.dtype).tobytes()
            found += [data[x:y] for x, y in zip([0, *(cut + w).tolist()], [*cut.tolist(), len(data)], strict=True)]
        return found

    @staticmethod
    def _raw(key: str) -> str:
        """The piece that a key stands for: after a carriage return as it is, after a line feed too, else with a space before it."""
        return key[1:] if key[:1] == "\r" else key if key[:1] == "\n" else " " + key

    def _known(self, keys: list[str], learn) -> list[bytes]:
        """Ids of different words or pieces; all new ones are learnt in one call."""
        young = self.young
        new = [p for p in keys if p not in young]
        if len(young) + len(new) > self.known:
            self.old, self.young = young, {}
            young, new = self.young, keys
        old = self.old
        if old and new:
            young.update((p, old[p]) for p in new if p in old)
            new = [p for p in new if p not in young]
        if new:
            young.update(zip(new, learn(new), strict=True))
        return [young[p] for p in keys]

    def _few(self, keys: list[str]) -> list[bytes]:
        """Ids of few different pieces, by their keys."""
        few = self.few
        if len(few) > KNOWN_FEW:
            few.clear()
        easy, hard = [], []
        for k in keys:
            if k not in few:
                match = SIMPLE_KEY.fullmatch(k) if self.simple else None
                if match is None:
                    hard.append(k)
                    continue
                lead, word, rest = match.groups("")
                easy.append((k, lead, word.lower() if self.lower else " " + word if lead in ("", "\r ") else word, rest))
        words = list(dict.fromkeys(word for _, _, word, _ in easy))
        ids = dict(zip(words, self._known(words, self._learn_words), strict=True))
        for k, lead, word, rest in easy:
            line = self._part(LINE) if lead[-1:] == "\n" and not self.lower else b""
            few[k] = line + ids[word] + (self._part(rest) if rest else b"")
        few.update(zip(hard, self._known(hard, self._learn), strict=True))
        return [few[k] for k in keys]

    def _many(self, keys):
        """Ids of different pieces, by their keys, as Arrow's kernels find them."""
        np, pa, pc = self.np, self.pa, self.pc
        if not self.simple:
            return pa.array(self._known(keys.to_pylist(), self._learn), pa.large_binary())
        found = pc.extract_regex(keys, rf"\A{SIMPLE}\z")
        easy = found.is_valid()
        lead, word, rest = found.filter(easy).flatten()
        if self.lower:
            word = pc.utf8_lower(word)
        else:
            spaced = pc.or_(pc.equal(lead, ""), pc.equal(lead, "\r "))
            empty, space = (pa.scalar(c, pa.large_string()) for c in ("", " "))
            word = pc.binary_join_element_wise(pc.if_else(spaced, space, empty), word, empty)
        words, rests = word.dictionary_encode(), rest.dictionary_encode()
        parts = [pa.array(self._known(words.dictionary.to_pylist(), self._learn_words), pa.large_binary()).take(words.indices)]
        parts.append(pa.array([self._part(r) if r else b"" for r in rests.dictionary.to_pylist()], pa.large_binary()).take(rests.indices))
        if not self.lower:
            lines = pa.array([b"", self._part(LINE)], pa.large_binary())
            parts.insert(0, lines.take(pc.ends_with(lead, "\n").cast(pa.int8())))
        hard = self._known(keys.filter(pc.invert(easy)).to_pylist(), self._learn)
        ids = pa.concat_arrays([pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary())), pa.array(hard, pa.large_binary())])
        order = np.empty(len(keys), np.int64)
        order[np.argsort(~easy.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(keys))
        return ids.take(pa.array(order))

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        np, pa = self.np, self.pa
        plain, keys, sizes, order = [], [], [], []  # texts that spaces alone divide; pieces of the others
        out: list[bytes | None] = [None] * len(texts)
        for i, t in enumerate(texts):
            if self.has_special(t):
                parts = self.specials.split(t)  # every second one is a special token
                ids = iter(self.encode(parts[::2]))
                out[i] = b"".join(self.special[p].to_bytes(self.width, "little") if k % 2 else next(ids) for k, p in enumerate(parts))
                continue
            spaced = t.replace("\n", " \n")
            if "  " in spaced or "\n " in spaced or "\t" in t or "\r" in t or any(c in t for c in UNUSUAL_SPACE):
                pieces = PIECES.split(t)
                keys += ["\r" + p for p in pieces]
                sizes.append(len(pieces))
                order.append(i)
            else:
                plain.append((i, "\r" + spaced))
        lists = self.pc.split_pattern(pa.array([t for _, t in plain], pa.large_string()), " ")
        ends = np.concatenate([np.diff(lists.offsets.to_numpy()), np.array(sizes, np.int64)]).cumsum()
        if not len(ends):
            return out
        coded = pa.concat_arrays([lists.flatten(), pa.array(keys, pa.large_string())]).dictionary_encode()
        pieces = coded.dictionary
        taken = (self._many(pieces) if len(pieces) >= FEW else pa.array(self._few(pieces.to_pylist()), pa.large_binary())).take(coded.indices)
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[ends].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        for i, a, b in zip([*(i for i, _ in plain), *order], [0, *at], at, strict=False):
            out[i] = bytes(data[a:b])
        return out


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest, in order, from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int = 4) -> WordEncoder:
    """The Python worker's encoder of this file; later tasks of the same worker find its words again."""
    if (path, width) not in _encoders:
        _encoders.clear()
        _encoders[path, width] = WordEncoder(path, width)
    return _encoders[path, width]


def in_slices(texts: list[str], most_chars: int = 6_000_000):
    """Index ranges of about ``most_chars`` characters each, so that what a batch holds stays small."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
