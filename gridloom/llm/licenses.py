"""License scans: exact phrases, and short notices with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices that are searched with errors, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
    "dedicated to the public domain": "public-domain",
}

#: A notice of n characters is found with up to n // EDIT errors (insertions, deletions, substitutions).
EDIT = 10

#: Bytes of UTF-8 as they stand in words (A-Z lower-cased), all others as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(notice: str, errors: int) -> list[tuple[str, int]]:
    """The notice cut into errors + 1 parts with their places: by the pigeonhole principle one stays exact."""
    edges = [round(len(notice) * i / (errors + 1)) for i in range(errors + 2)]
    return [(notice[a:b], a) for a, b in zip(edges, edges[1:])]


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        self.phrases = [(f" {k} ".encode(), v) for k, v in phrases.items()]
        seeds: dict[str, list] = {}
        self.patterns = []
        for i, (notice, label) in enumerate(notices.items()):
            errors = len(notice) // EDIT
            pattern = regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice)}){{e<={errors}}}(?= )".encode())
            self.patterns.append((pattern, notice, label, errors))
            for text, at in pieces(notice, errors):
                seeds.setdefault(text, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for text, where in seeds.items():
            self.automaton.add_word(text, (len(text), where))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
        line = b" " + b" ".join(words) + b" "
        base = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                base.append((at, label))
                at = line.find(phrase, at + 1)
        base.sort()
        spans = sorted(set(self._fuzzy(line)))
        starts = self._word_numbers(line, [at for at, _ in base])
        ends = self._word_numbers(line, [x for a, b, *_ in spans for x in (a - 1, b - 1)])
        found = [{"first_word": ends[a - 1], "last_word": ends[b - 1] - 1, "label": label, "notice": notice, "errors": e} for a, b, label, notice, e in spans]
        labels = {label for _, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": starts[base[0][0]] if base else None,
            "last_word": starts[base[-1][0]] if base else None,
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {s["label"] for s in found})),
            "score": 1.0 if base else max((1 - s["errors"] / len(s["notice"]) for s in found), default=0.0),
            "spans": found,
        }

    @staticmethod
    def _word_numbers(line: bytes, spaces: list[int]) -> dict[int, int]:
        """For positions in the line: how many spaces come before each."""
        out, at, n = {}, 0, 0
        for p in sorted(set(spaces)):
            n += line.count(b" ", at, p)
            at = p
            out[p] = n
        return out

    def _fuzzy(self, line: bytes) -> Iterator[tuple]:
        """(start, end, label, notice, errors) of the best match in each place with a seed, and of those beside it."""
        reach: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(line.decode("latin-1")):
            for i, at in where:
                _, notice, _, errors = self.patterns[i]
                low = max(0, end + 1 - size - at - errors - 1)
                high = min(len(line), end + 1 - size - at + len(notice) + errors + 1)
                regions = reach.setdefault(i, [])
                if regions and low <= regions[-1][1]:
                    regions[-1][0], regions[-1][1] = min(low, regions[-1][0]), max(high, regions[-1][1])
                else:
                    regions.append([low, high])
        for i, regions in reach.items():
            pattern, notice, label, errors = self.patterns[i]
            for low, high in regions:
                todo = [(low, high)]
                while todo:  # the best match of a stretch, then what lies before and after it
                    low, high = todo.pop()
                    m = pattern.search(line, low, high)
                    if m and m.end() > m.start():
                        yield m.start(), m.end(), label, notice, sum(m.fuzzy_counts)
                        todo += [x for x in ((low, m.start()), (m.end(), high)) if x[1] - x[0] > len(notice) - errors]


SPAN = "array<struct<first_word:long,last_word:long,label:string,notice:string,errors:int>>"


def scan_licenses(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters, numbered from 0. n_base counts
    every place where a phrase's words stand consecutively. Notices are searched with errors: seeds of their
    pigeonhole pieces give the places, the regex library verifies them within the error bound; spans holds the
    best matches by first and last word, with those that stand before and after a better one. score is 1 with a base phrase, else 1 - errors / length of the
    closest notice, 0 without any.

    Null and empty texts have no words, no labels and score 0. Texts are scanned whole. Repeated rows and null ids
    each give a row. An empty table gives no rows. Other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, notices)
        for x in batches:
            found = pd.DataFrame([scanner.scan(t) for t in x["text"]], columns=COLUMNS)
            found.insert(0, "id", x["id"].to_numpy())
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    return out.withColumnRenamed("id", id_col)


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
