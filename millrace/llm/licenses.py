"""License scans by template markup.

A template is a license's wording with two kinds of markup: a region between `<<beginOptional>>` and `<<endOptional>>` may
be there or not (regions nest), and `<<var;name=...;words=A-B>>` stands for A to B words of any kind, or with `match=x|y` for
one of the given wordings. Templates and texts are compared by words alone: A-Z lower-cased, a word a run of digits, a-z or
characters beyond ASCII, so that layout and punctuation play no part. A template is compiled to an automaton over words;
it accepts a text if some stretch of it has all the mandatory wording, in order and with nothing in between but what the
markup allows. Optional and replaceable regions at a template's ends can't change that and are left out.

Automata are made deterministic step by step as texts are read. One starts where the first mandatory words of its template
stand, found by a search for that string; the other words of a text are never looked at. Besides templates there are plain
phrases, whose places are all counted.

Nulls and edges: a null text counts as empty, which holds nothing; texts of any length are read whole; overlapping places
count each; rows that repeat, also by id, are scanned each; null ids are kept; of the kept columns those with a name of the
result's own (`RESULT`) are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_texts

RESULT = ("n_words", "base", "spans")

#: Words of a text: what is kept as it is, A-Z lower-cased; all other characters are borders.
_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

# Phrases, their labels, and the public wording of licenses and of the notices that refer to them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("gpl-2.0", "GNU General Public License <<beginOptional>>as published by the Free Software Foundation;<<endOptional>> <<beginOptional>>either<<endOptional>> <<var;name=version;match=version 2|version 2.0|v2|v2.0>>"),
    ("gpl-3.0", "GNU General Public License <<beginOptional>>as published by the Free Software Foundation,<<endOptional>> <<beginOptional>>either<<endOptional>> <<var;name=version;match=version 3|version 3.0|v3|v3.0>>"),
    ("gpl-header", "<<var;name=program;words=0-5>> is free software <<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU <<var;name=kind;match=Lesser|Library>> General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this file except in compliance with the License.<<endOptional>>"),
    ("apache-2.0", "Apache <<beginOptional>>Software<<endOptional>> License <<beginOptional>>,<<endOptional>> <<beginOptional>>Version<<endOptional>> <<var;name=version;match=2.0|v2.0|v2>>"),
    ("cc-by-4.0", "CC BY <<var;name=version;match=4.0>>"),
    ("cc-by-nc-4.0", "CC BY NC <<var;name=version;match=4.0>>"),
    ("cc-by-sa-4.0", "CC BY SA <<var;name=version;match=4.0>>"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0-1.0", "<<var;name=kind;match=CC0 1.0|CC0 1.0 Universal>> <<beginOptional>>Public Domain Dedication<<endOptional>>"),
    ("mit-notice", "<<var;name=how;match=Released|Licensed|Distributed|Available>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    (
        "mit-text",
        """<<beginOptional>>The MIT License (MIT)<<endOptional>> <<var;name=copyright;words=0-30>>
Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;match=this software and associated documentation files|this software>>
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
<<beginOptional>>sublicense,<<endOptional>> and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE <<var;name=holder;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY""",
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;words=1-12>> DISCLAIMS ALL WARRANTIES""",
    ),
    (
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;name=number;words=0-1>>
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;name=number;words=0-1>>
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
<<beginOptional>><<var;name=number;words=0-1>> Neither the name of <<var;name=holder;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<endOptional>>
THIS SOFTWARE IS PROVIDED BY <<var;name=holder;words=1-12>> "AS IS\"""",
    ),
    ("bsd-3-clause", "Neither the name of <<var;name=holder;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved <<beginOptional>>worldwide<<endOptional>>. No part of this <<var;name=work;words=1-3>> may be reproduced"),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


# A template's parts: a word; ("any", a, b); ("one", [words, ...]); ("optional", parts).
def parse(template: str) -> list:
    """The parts of a template."""
    stack: list[list] = [[]]
    for piece in re.split(r"(<<.*?>>)", template, flags=re.S):
        if piece == "<<beginOptional>>":
            stack.append([])
        elif piece == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError(f"an optional region ends that has no beginning: {template[:60]}")
            inner = stack.pop()
            if inner:
                stack[-1].append(("optional", inner))
        elif piece.startswith("<<"):
            options = dict(o.split("=", 1) for o in piece[2:-2].split(";")[1:])
            if not piece.startswith("<<var;") or not ("match" in options) ^ ("words" in options):
                raise ValueError(f"no such markup: {piece}")
            if "words" in options:
                low, high = map(int, options["words"].split("-"))
                stack[-1].append(("any", low, high))
            else:
                stack[-1].append(("one", [words_of(w) for w in options["match"].split("|")]))
        else:
            stack[-1] += words_of(piece)
    if len(stack) > 1:
        raise ValueError(f"an optional region does not end: {template[:60]}")
    parts = stack[0]
    free = lambda p: not isinstance(p, bytes) and (p[0] == "optional" or (p[0] == "any" and not p[1]))
    while parts and free(parts[0]):
        parts = parts[1:]
    while parts and free(parts[-1]):
        parts = parts[:-1]
    return parts


class Automaton:
    """Accepts word sequences; states are sets of positions in a list of steps, made as they are met."""

    def __init__(self, parts: list):
        self.steps: list[tuple] = []  # ("word", w), ("any",), ("fork", other), ("jump", to), ("end",)
        self._compile(parts)
        self.steps.append(("end",))
        self.begin = self._closed({0})
        self.moves: dict[tuple[frozenset, bytes], frozenset] = {}
        self.vocabulary = {s[1] for s in self.steps if s[0] == "word"}

    def _compile(self, parts: list) -> None:
        for p in parts:
            if isinstance(p, bytes):
                self.steps.append(("word", p))
            elif p[0] == "any":
                self.steps += [("any",)] * p[1]
                for _ in range(p[2] - p[1]):
                    self._fork(lambda: self.steps.append(("any",)))
            elif p[0] == "optional":
                self._fork(lambda inner=p[1]: self._compile(inner))
            else:
                self._choice(p[1])

    def _fork(self, body) -> None:
        """What `body` compiles may be left out."""
        at = len(self.steps)
        self.steps.append(())
        body()
        self.steps[at] = ("fork", len(self.steps))

    def _choice(self, wordings: list[list[bytes]]) -> None:
        jumps = []
        for k, w in enumerate(wordings):
            at = len(self.steps)
            last = k == len(wordings) - 1
            if not last:
                self.steps.append(())
            self.steps += [("word", x) for x in w]
            if not last:
                jumps.append(len(self.steps))
                self.steps.append(())
                self.steps[at] = ("fork", len(self.steps))
        for j in jumps:
            self.steps[j] = ("jump", len(self.steps))

    def _closed(self, at: set[int]) -> frozenset:
        seen, todo = set(), list(at)
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                step = self.steps[k]
                if step[0] == "fork":
                    todo += [k + 1, step[1]]
                elif step[0] == "jump":
                    todo.append(step[1])
        return frozenset(k for k in seen if self.steps[k][0] in ("word", "any", "end"))

    def accepts(self, words: list[bytes], at: int) -> int | None:
        """Where the shortest accepted stretch from `at` on ends, if there is one."""
        state, end = self.begin, len(self.steps) - 1
        while state:
            if end in state:
                return at
            if at == len(words):
                return None
            word = words[at] if words[at] in self.vocabulary else b""
            key = (state, word)
            if key not in self.moves:
                self.moves[key] = self._closed({k + 1 for k in state if self.steps[k] == ("any",) or self.steps[k] == ("word", word)})
            state, at = self.moves[key], at + 1
        return None


def openings(parts: list) -> list[bytes]:
    """Strings of words of which one stands where an accepted stretch begins: the mandatory words up to the first markup."""
    run = []
    for p in parts:
        if isinstance(p, bytes):
            run.append(p)
            continue
        if not run and p[0] == "one":
            return [b" " + b" ".join(w) + b" " for w in p[1]]
        break
    return [b" " + b" ".join(run) + b" "] if run else []


@dataclass
class Scanner:
    phrases: dict[str, str]
    templates: list[tuple[str, str]]
    compiled: list[tuple[str, list[bytes], Automaton]] = field(init=False)

    def __post_init__(self):
        self.compiled, self.strings = [], [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in self.phrases.items()]
        for label, template in self.templates:
            parts = parse(template)
            found = openings(parts)
            if not found or b"  " in found:
                raise ValueError(f"a template must begin with wording: {template[:60]}")
            self.compiled.append((label, found, Automaton(parts)))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """How many words there are; the places of phrases, and what templates accept, each (first word, words, label)."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        base = [(at, string.count(b" ") - 1, label) for string, label in self.strings for at in _places(line, string)]
        spans = set()
        for label, starts, automaton in self.compiled:
            for string in starts:
                for at in _places(line, string):
                    end = automaton.accepts(words, at)
                    if end is not None:
                        spans.add((at, end - at, label))
        return len(words), sorted(base), sorted(spans)


def _places(line: bytes, string: bytes) -> list[int]:
    """Numbers of the words at which `string`, words between spaces, stands in `line`."""
    out, at, seen, word = [], line.find(string), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = line.find(string, at + 1)
    return out


def scan(df: DataFrame, kept: list[str], text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """`kept` columns; n_words; base and spans, arrays of (start, length, label): places of phrases, and accepted stretches."""
    Scanner(phrases, templates)  # refuses bad templates here
    made: list[Scanner] = []

    def rows(texts: list[str | None]) -> dict:
        if not made:
            made.append(Scanner(phrases, templates))
        found = [made[0].scan(t) for t in texts]
        named = lambda spans: [dict(zip(("start", "length", "label"), s, strict=True)) for s in spans]
        return {"n_words": [f[0] for f in found], "base": [named(f[1]) for f in found], "spans": [named(f[2]) for f in found]}

    span = "array<struct<start:long,length:long,label:string>>"
    return over_texts(df, [c for c in kept if c not in RESULT], text_col, f"n_words long, base {span}, spans {span}", rows)


def labels(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.col(column)["label"]))


def certainty() -> Column:
    """0 without any sign of a license, then nearer to 1: a phrase halves what is missing, a template's label quarters it."""
    return 1 - F.pow(F.lit(0.5), F.size("base") + 2 * F.size(labels("spans")))


def regex(template: str) -> str:
    """A template as a regular expression over words that each have a space after them, for tests in SQL."""

    def of(parts: list) -> str:
        out = ""
        for p in parts:
            if isinstance(p, bytes):
                out += p.decode() + " "
            elif p[0] == "any":
                out += f"(?:[^ ]+ ){{{p[1]},{p[2]}}}"
            elif p[0] == "optional":
                out += f"(?:{of(p[1])})?"
            else:
                out += "(?:" + "|".join(of(w) for w in p[1]) + ")"
        return out

    return " " + of(parse(template))
