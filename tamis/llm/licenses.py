"""License scan: exact base phrases, and fuzzy search for short notices.

A text becomes its lower-cased words joined by single blanks, with a blank at each end. A notice may differ from it
by at most `errors` edits (insertions, deletions, substitutions of characters). Split into errors + 1 pieces, one
piece at least must stand there unchanged (pigeonhole), so one pass of an Aho-Corasick automaton over all pieces
gives every candidate place; there the regex library's bounded-error matching decides and reports the span. Nothing
is shuffled: each document is searched where it is read.

Cases: a null or empty text has no words, no labels and a score of 0; repeated rows are scanned each for itself; of
matches that begin at one character the one with fewest errors stays; a very long text is scanned whole, in time that
grows with its length and its hits; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM_BYTES, documents, text_bytes

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of common notices and the label each stands for.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under a creative commons attribution": "cc",
    "licensed under cc by": "cc-by",
    "free and unencumbered software released into the public domain": "unlicense",
    "this work is dedicated to the public domain": "public-domain",
    "cc0 1 0 universal": "cc0-1.0",
    "licensed under the isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "distributed under the boost software license version 1 0": "bsl-1.0",
    "licensed under the eclipse public license": "epl",
    "licensed under the european union public licence": "eupl",
    "licensed under the zlib license": "zlib",
    "licensed under the artistic license": "artistic",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "open data commons open database license": "odbl",
    "do what the fuck you want to public license": "wtfpl",
    "all rights reserved": "reserved",
}
#: One edit for so many characters of a notice, up to MOST_ERRORS.
CHARS_PER_ERROR, MOST_ERRORS = 10, 3


_blank = re.compile(" ")


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int

    @property
    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): errors + 1 pieces of about the same length."""
        n = self.errors + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: dict[str, str], base: dict[str, str], chars_per_error: int = CHARS_PER_ERROR, most_errors: int = MOST_ERRORS):
        import ahocorasick

        self.notices = [Notice(label, f" {words} ", min(most_errors, len(words) // chars_per_error)) for words, label in notices.items()]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text, special_only=True)}){{e<={n.errors}}}") for n in self.notices]
        self.base = base
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for offset, piece in notice.pieces:
                seeds.setdefault(piece, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first character, end, errors, likeness) of the notices found."""
        windows = set()
        for end, (length, uses) in self.seeds.iter(text):
            for k, offset in uses:
                n = self.notices[k]
                start = end + 1 - length - offset - n.errors
                windows.add((k, max(0, start), min(len(text), start + len(n.text) + 2 * n.errors)))
        found = {}
        for k, a, b in sorted(windows):
            if m := self.patterns[k].search(text, a, b):
                errors = sum(m.fuzzy_counts)
                if found.get((k, m.start()), (9,))[0] > errors:
                    found[k, m.start()] = (errors, m.end())
        return [(self.notices[k].label, a, b, e, 1 - e / len(self.notices[k].text)) for (k, a), (e, b) in sorted(found.items())]

    def exact(self, text: str) -> list[tuple[str, int]]:
        """(label, first character) of every place of a base phrase, overlapping ones included."""
        found = []
        for words, label in self.base.items():
            at = text.find(f" {words} ")
            while at >= 0:
                found.append((label, at))
                at = text.find(f" {words} ", at + 1)
        return found


SPAN = "label string, start_word bigint, end_word bigint, errors int"
FOUND = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<{SPAN.replace(' ', ':').replace(',:', ', ')}>>"


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Per document: counts and places of the base phrases, labels, score and the spans of the fuzzy notices.

    The score is that of the best place found: 1 for an exact phrase, less the share of edited characters for a
    fuzzy notice, 0 if nothing was found.
    """
    notices, base = NOTICES if notices is None else notices, BASE if base is None else base
    spans = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int32())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, base)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for raw in batch.column(1).to_pylist():
                words = raw.translate(ALNUM_BYTES).split()
                text = f" {b' '.join(words).decode()} "
                exact, fuzzy = scanner.exact(text), scanner.fuzzy(text)
                blanks = [m.start() for m in _blank.finditer(text)] if exact or fuzzy else []
                word_at = lambda i: bisect_right(blanks, i) - 1  # noqa: B023, E731  index of the word that begins after blank i
                exact = [(label, word_at(i)) for label, i in exact]
                places = [w for _, w in exact]
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted({x for x, _ in exact})))
                out["labels"].append(",".join(sorted({x for x, _ in exact} | {f[0] for f in fuzzy})))
                out["score"].append(1.0 if exact else max((f[4] for f in fuzzy), default=0.0))
                out["spans"].append([{"label": f[0], "start_word": max(0, word_at(f[1])), "end_word": word_at(f[2] - 1) + (text[f[2] - 1] != " "), "errors": f[3]} for f in fuzzy])
            columns = [batch.column(0), *(pa.array(v, kinds[k]) for k, v in out.items())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *kinds])

    return docs.select("doc_id", text_bytes()).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
