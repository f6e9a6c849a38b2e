"""Token ids by the tokenizers library, with a bounded cache of encoded units.

Both tokenisers cut a text at white space before they merge anything, so the ids of a text are the ids of its
white-space units one after another. Units repeat, so a worker asks the library once for each and keeps the answer.
A unit of letters with punctuation after it, by far the most frequent kind, goes to the library's model at once;
other units go through its whole path. Texts with characters outside printable ASCII and Latin-1, and texts that
contain a special token's string, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Encoded units that a worker keeps, about 250 bytes each; further ones are encoded when they occur.
CACHE_UNITS = 600_000

_plain = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*").fullmatch
_spaced = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
#: Letters, then ASCII punctuation: what both tokenisers cut to these two parts.
_common = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
#: White space other than single blanks and newlines: such texts are cut by the slower pattern.
_unusual = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r")


class Units(dict):
    """Unit -> ids as bytes. Begins with a newline: as it stands; with a zero: what follows; else after a blank."""

    def __init__(self, tokenizer, blanks: bool):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer, self.model, self.blanks = tokenizer, tokenizer.model, blanks
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(0x20, 0x100)}

    def __missing__(self, unit: str) -> bytes:
        if m := _common(unit):
            letters, rest = m.groups()
            parts = [" " + letters if self.blanks else letters.lower(), rest]
            ids = [t.id for p in parts if p for t in self.model.tokenize(p.translate(self.level))]
        else:
            text = unit[1:] if unit[:1] == "\0" else unit if unit[:1] == "\n" or not self.blanks else " " + unit
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = np.array(ids, "<u4").tobytes()
        if len(self) < CACHE_UNITS:
            self[unit] = found
        return found


class Encoder:
    """ids(texts) gives the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, name_or_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name_or_path if os.path.isabs(name_or_path) else public_tokenizers.path(name_or_path)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A byte-level vocabulary keeps the blank before a word; the other one drops white space.
        self.blanks = self.tokenizer.normalizer is None
        self.units = Units(self.tokenizer, self.blanks)

    def cut(self, text: str) -> list[str]:
        if not self.blanks:
            return text.split()
        if text.endswith("\n\n") or any(x in text for x in _unusual):
            return [u[1:] if u[0] == " " and u[1:2] != "\n" else "\0" + u for u in _spaced(text)]
        found = text.replace("\n", " \n").split(" ")
        if found[0]:
            found[0] = "\0" + found[0]
        elif len(found) > 1:
            del found[0]  # the text begins with a blank or a newline
        else:
            found = []
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        get, out = self.units.__getitem__, []
        for t in texts:
            if _plain(t) and not any(s in t for s in self.specials):
                out.append(b"".join(map(get, self.cut(t))))
            else:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One per Python worker: its cache lives as long as the worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def in_groups(ids: list, texts: list, most_chars: int = 2_000_000):
    """Slices of a batch of bounded size, so that memory follows the longest text and not the batch."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield ids[start:], texts[start:]
