"""License scans: license templates with markup, compiled to token automata.

A template is the wording of a license or notice with three kinds of regions:

* ``<<optional>> words <<end>>`` may be there or not;
* ``<<either>> words <<or>> other words <<end>>`` is one of several wordings;
* ``<<any 0 12>>`` stands for so many words of any kind (names, years).

All else is mandatory and has to match word by word. Regions may hold regions. A template begins with
two mandatory words. All templates become one automaton over word numbers; its subset states are made
as they are met. A text is cut into words once; the automaton starts only where two neighbouring words
begin a template, found for all texts of a step together, and ends as soon as no template goes on. A
template yields one match per place, its longest. ``base`` templates are plain phrases; their matches are
reported like all others and marked.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.

Defined cases: null and empty texts have no words and no match; repeated rows are scanned each; rows
without doc_id keep none; an empty table has no rows; a long text is cut into words piece by piece and
matched as a whole; columns other than doc_id and text are not looked at.
"""

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, byte_texts, lower_ascii, steps, table, word_chunks

MOST_STATES = 20_000  # subset states and their transitions that a worker keeps


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


# fixed values: phrases and labels that every scan reports
BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

# fixed values: wording of widespread licenses and notices
TEMPLATES = (
    Template("mit", "released under <<optional>>the terms of<<end>> <<optional>>the<<end>> mit license"),
    Template("mit", "licensed under <<optional>>the terms of<<end>> <<optional>>the<<end>> mit license"),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files <<optional>>(the "Software")<<end>>, to deal in the Software without
        restriction, including without limitation <<optional>>on<<end>> the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included
        in all copies or substantial portions of <<any 1 8>> Software""",
    ),
    Template("apache-2.0", "licensed under the Apache License, version 2 <<optional>>0<<end>>"),
    Template(
        "apache-2.0",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied""",
    ),
    Template(
        "gpl-3.0",
        """general public license <<optional>>as published by the Free Software Foundation<<end>>
        <<optional>>either<<end>> <<either>>version 3<<or>>v3<<end>>""",
    ),
    Template(
        "gpl-2.0",
        """general public license <<optional>>as published by the Free Software Foundation<<end>>
        <<optional>>either<<end>> <<either>>version 2<<or>>v2<<end>>""",
    ),
    Template("lgpl", "gnu lesser general public license"),
    Template("lgpl", "gnu library general public license"),
    Template("agpl", "gnu affero general public license"),
    Template(
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: <<any 0 1>> Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. <<any 0 1>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the
        distribution""",
    ),
    Template(
        "bsd-3-clause",
        """in the documentation and/or other materials provided with the distribution. <<any 0 1>> Neither the
        name of <<any 1 20>> nor the names of <<any 1 4>> contributors may be used to endorse or promote
        products derived from this software without specific prior written permission""",
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies""",
    ),
    Template(
        "mpl-2.0",
        "subject to the terms of the Mozilla Public License, <<either>>v 2<<or>>version 2<<end>> 0",
    ),
    Template(
        "cc-by-nc",
        """licensed under <<optional>>a<<end>> <<either>>cc by nc<<or>>creative commons attribution
        <<either>>noncommercial<<or>>non commercial<<end>><<end>> <<optional>>4 0<<end>>""",
    ),
    Template(
        "cc-by-sa",
        """licensed under <<optional>>a<<end>> <<either>>cc by sa<<or>>creative commons attribution
        <<either>>sharealike<<or>>share alike<<end>><<end>> <<optional>>4 0<<end>>""",
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("reserved", "all rights reserved"),
    Template("spdx", "spdx license identifier <<any 1 1>>"),
)

_WORD = re.compile(ALNUM_WORD)
_PART = re.compile(r"<<\s*(.*?)\s*>>|([^<]+|<)", re.S)


def parse_markup(markup: str) -> tuple:
    """A sequence of words (bytes), ("any", least, most), ("optional", seq) and ("either", seqs)."""
    open_regions: list[list] = [["all", [[]]]]
    for mark, plain in _PART.findall(markup):
        within = open_regions[-1][1][-1]
        if not mark:
            within.extend(_WORD.findall(lower_ascii(plain.encode())))
        elif mark in ("optional", "either"):
            open_regions.append([mark, [[]]])
        elif mark == "or" and open_regions[-1][0] == "either":
            open_regions[-1][1].append([])
        elif mark == "end" and len(open_regions) > 1:
            kind, ways = open_regions.pop()
            found = tuple(map(tuple, ways))
            open_regions[-1][1][-1].append((kind, found[0]) if kind == "optional" else (kind, found))
        elif counts := re.fullmatch(r"any (\d+) (\d+)", mark):
            within.append(("any", int(counts[1]), int(counts[2])))
        else:
            raise ValueError(f"unknown mark {mark!r}")
    if len(open_regions) > 1:
        raise ValueError("a region has no end")
    return tuple(open_regions[0][1][0])


def mandatory_words(parts: tuple) -> int:
    return sum(isinstance(p, bytes) for p in parts)


END, OTHER = 0, 1  # numbers of a text's end, which nothing accepts, and of words in no template


class LicenseAutomaton:
    """Finds all places where one of the templates matches."""

    def __init__(self, templates: Sequence[Template]):
        self.vocabulary: dict[bytes, int] = {b"": END}
        # states of the automaton: words that lead on, states that any word leads to, states without a word
        self.by_word: list[dict[int, set[int]]] = []
        self.by_any: list[set[int]] = []
        self.free: list[set[int]] = []
        self.accepts: dict[int, int] = {}
        start = self._state()
        for number, template in enumerate(templates):
            parts = parse_markup(template.markup)
            if not all(isinstance(p, bytes) for p in parts[:2]) or len(parts) < 2:
                raise ValueError(f"template {template.label!r} has to begin with two mandatory words")
            first = self._state()
            self.free[start].add(first)
            self.accepts[self._add(parts, first)] = number
        self.start = self._closure({start})
        # both first words of every template, as one number
        size = len(self.vocabulary) + 1
        pairs = [
            a * size + b
            for a in self._leads(self.start)
            for b in self._leads(self._step(self.start, a))
        ]
        self.begins = np.zeros(size * size, bool)
        self.begins[pairs] = True
        self.size = size
        self._forget()

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(set())
        self.free.append(set())
        return len(self.free) - 1

    def _add(self, parts: tuple, at: int) -> int:
        """Append the parts behind the state ``at``; the state behind them."""
        for part in parts:
            after = self._state()
            if isinstance(part, bytes):
                word = self.vocabulary.setdefault(part, len(self.vocabulary) + 1)
                self.by_word[at].setdefault(word, set()).add(after)
            elif part[0] == "any":
                for count in range(part[2]):
                    if count >= part[1]:
                        self.free[at].add(after)
                    on = self._state()
                    self.by_any[at].add(on)
                    at = on
                self.free[at].add(after)
            else:
                ways = [part[1], ()] if part[0] == "optional" else part[1]
                for way in ways:
                    self.free[self._add(way, at)].add(after)
            at = after
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for state in self.free[todo.pop()] - seen:
                seen.add(state)
                todo.append(state)
        return frozenset(seen)

    def _leads(self, states: frozenset[int]) -> set[int]:
        return {word for s in states for word in self.by_word[s]}

    def _step(self, states: frozenset[int], word: int) -> frozenset[int]:
        found: set[int] = set()
        for state in states:
            found |= self.by_word[state].get(word, set())
            if word != END:
                found |= self.by_any[state]
        return self._closure(found)

    def _forget(self) -> None:
        self.numbers = {self.start: 0}
        self.states = [self.start]
        self.moves: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]

    def _move(self, state: int, word: int) -> int:
        after = self._step(self.states[state], word)
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
            self.moves.append({})
            self.ends.append(sorted(self.accepts[s] for s in after if s in self.accepts))
        self.moves[state][word] = self.numbers[after]
        return self.numbers[after]

    def word_numbers(self, text: bytes) -> list[int]:
        """Numbers of a text's words, and END."""
        numbers: list[int] = []
        for words in word_chunks(lower_ascii(text), _WORD):
            numbers.extend(map(self.vocabulary.get, words, [OTHER] * len(words)))
        numbers.append(END)
        return numbers

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Template, first word and word behind the last, of every match in joined texts, by place."""
        if len(self.states) > MOST_STATES:
            self._forget()
        pairs = words[:-1].astype(np.int64) * self.size + words[1:]
        for begin in np.flatnonzero(self.begins[pairs]).tolist():
            state, at, found = 0, begin, {}
            while self.states[state]:
                word = int(words[at])
                after = self.moves[state].get(word)
                state = self._move(state, word) if after is None else after
                at += 1
                for template in self.ends[state]:
                    found[template] = at
            for template, end in sorted(found.items()):
                yield template, begin, end


_MATCH = "array<struct<label:string,base:boolean,start:bigint,end:bigint,mandatory:int>>"


def license_matches(docs: DataFrame, templates: Sequence[Template] = BASE + TEMPLATES) -> DataFrame:
    """doc_id, n_words and matches of each row: label, base, start and end (words from 0, the end not
    included) and number of mandatory words of the template, in the order of their places."""
    templates = tuple(templates)
    LicenseAutomaton(templates)  # a bad template fails here and not in a task
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LicenseAutomaton(templates)
        mandatory = [mandatory_words(parse_markup(t.markup)) for t in templates]
        for batch in steps(batches):
            numbers, counts = [], []
            for text in byte_texts(batch.column("text")):
                found = automaton.word_numbers(text)
                numbers.append(np.array(found, np.int32))
                counts.append(len(found))
            limits = np.concatenate([[0], np.cumsum(counts)])
            rows: list[list[dict]] = [[] for _ in counts]
            for template, begin, end in automaton.matches(np.concatenate(numbers)):
                row = int(np.searchsorted(limits, begin, "right")) - 1
                rows[row].append(
                    {
                        "label": templates[template].label,
                        "base": templates[template].base,
                        "start": begin - int(limits[row]),
                        "end": end - int(limits[row]),
                        "mandatory": mandatory[template],
                    }
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(counts, np.int64) - 1), pa.array(rows, _ARROW)],
                ["doc_id", "n_words", "matches"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words bigint, matches {_MATCH}")


_ARROW = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("base", pa.bool_()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("mandatory", pa.int32()),
        ]
    )
)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score: 1 - 0.5 ** n of the match with most mandatory words n, so longer wordings are surer."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    surest = F.array_max(F.transform("matches", lambda m: m["mandatory"]))
    return license_matches(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.col("matches")).alias("labels"),
        F.coalesce(1 - F.pow(F.lit(0.5), surest), F.lit(0.0)).alias("score"),
    )


def _labels(matches):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def _pattern(parts: tuple) -> str:
    """A template as a regular expression over words that each follow a space."""
    out = []
    for part in parts:
        if isinstance(part, bytes):
            out.append(" " + part.decode())
        elif part[0] == "any":
            out.append(f"(?: [^ ]+){{{part[1]},{part[2]}}}")
        elif part[0] == "optional":
            out.append(f"(?:{_pattern(part[1])})?")
        else:
            out.append(f"(?:{'|'.join(_pattern(way) for way in part[1])})")
    return "".join(out)


def license_sql(templates: Sequence[Template] = BASE + TEMPLATES) -> str:
    """SQL of :func:`op11_license_scan`, with regular expressions in place of automata."""
    rows = ",\n  ".join(
        f"('{t.label}', {str(t.base).lower()}, {mandatory_words(parse_markup(t.markup))}, "
        f"'{_pattern(parse_markup(t.markup))} ')"
        for t in templates
    )
    return rf"""
WITH templates(label, base, mandatory, pattern) AS (VALUES
  {rows}
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), joined AS (
  SELECT doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM doc_words
), found AS (
  SELECT doc_id, label, base, mandatory FROM joined JOIN templates ON regexp_matches(line, pattern)
), summary AS (
  SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, 1 - pow(0.5, max(mandatory)) AS score
  FROM found GROUP BY doc_id
), places AS (
  SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word
  FROM joined, unnest(range(1, len(words) + 1)) AS r(i)
  WHERE (words[i] IN ('mit', 'apache') AND words[i + 1] = 'license')
    OR (words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license')
  GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM joined LEFT JOIN summary USING (doc_id) LEFT JOIN places USING (doc_id)
"""
