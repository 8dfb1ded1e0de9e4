"""License scans: template markup compiled into token automata.

A template is license wording with markup: ``<<beginOptional>>...<<endOptional>>`` may be missing, and
``<<var;name="..";words="a-b">>`` stands for a to b words of any wording, ``<<var;name="..";match="x y|z">>`` for one of
the listed wordings.  All other words are mandatory and must match exactly, one after the other, after lower-casing
A-Z.  All templates together form one automaton over words, whose subset states are built as texts need them; it is
started at every word that can begin a template, so all places are found, overlapping ones too.

Defined results: null, empty and word-less texts have no words and no matches; repeated rows and ids are judged each
by themselves; an empty table gives no rows.  Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_bytes, slices, words_of

ANY = None


@dataclass(frozen=True)
class Template:
    """``base``: a plain name phrase; the others are notices whose whole wording must be there."""

    label: str
    markup: str
    base: bool = False


#: Name phrases, and the public wording of widely used notices.
TEMPLATES = (
    Template("mit", "MIT License", True),
    Template("apache", "Apache License", True),
    Template("gpl", "General Public License", True),
    Template("apache-2.0", "Licensed under the <<beginOptional>>terms of the <<endOptional>>Apache License<<beginOptional>>, Version<<endOptional>> 2<<beginOptional>>.0<<endOptional>>"),
    Template("mit-notice", 'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";match="this software|this library|this program">> and associated documentation files <<beginOptional>>(the "Software")<<endOptional>>'),
    Template("mit-reference", 'Licensed under the <<beginOptional>>terms of the <<endOptional>>MIT License<<beginOptional>> (the "License")<<endOptional>>'),
    Template("gpl-notice", 'This program is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser <<endOptional>>General Public License as published by the Free Software Foundation <<var;name="version";words="0-8">> version <<var;name="number";words="1-2">>'),
    Template("gpl-reference", 'Licensed under the GNU General Public License <<beginOptional>>version <<endOptional>><<var;name="number";match="2|3|2 0|3 0|v2|v3">>'),
    Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc-notice", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by", 'This work is licensed under a Creative Commons <<var;name="kind";words="1-6">> License'),
)

_MARK = re.compile(r"<<(.*?)>>", re.S)


def parse(markup: str) -> list:
    """Parts of a template: a word, ('optional', parts), ('any', least, most) or ('one of', [words, ..])."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARK.finditer(markup), None]:
        stack[-1] += words_of(markup[at : m.start() if m else len(markup)].encode())
        if m is None:
            break
        at = m.end()
        tag, _, rest = m[1].partition(";")
        tag = tag.strip()
        if tag == "beginOptional":
            stack.append([])
        elif tag == "endOptional" and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif tag == "var":
            given = dict(re.findall(r'(\w+)="([^"]*)"', rest))
            if "words" in given:
                least, most = map(int, given["words"].split("-"))
                stack[-1].append(("any", least, most))
            else:
                stack[-1].append(("one of", [words_of(x.encode()) for x in given["match"].split("|")]))
        else:
            raise ValueError(f"unknown markup <<{m[1]}>>")
    if len(stack) != 1:
        raise ValueError("an optional region doesn't end")
    return stack[0]


class Automaton:
    """All templates as one automaton over words."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t.label for t in templates]
        self.moves: list[dict] = []  # of each state: word, or ANY, to states
        self.free: list[set] = []  # of each state: states reached without a word
        self.accepts: dict[int, int] = {}
        starts = []
        for number, t in enumerate(templates):
            begin = self._state()
            end = self._sequence(begin, parse(t.markup))
            if end in self._closure({begin}):
                raise ValueError(f"template {t.label} accepts no words at all")
            self.accepts[end] = number
            starts.append(begin)
        self.first = self._closure(starts)
        self.steps: dict[frozenset, dict] = {}
        if any(ANY in self.moves[s] for s in self.first):
            raise ValueError("a template must begin with a word")
        self.begins = frozenset(w for s in self.first for w in self.moves[s])

    def _state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def _word(self, at: int, word) -> int:
        to = self._state()
        self.moves[at].setdefault(word, set()).add(to)
        return to

    def _sequence(self, at: int, parts: list) -> int:
        for part in parts:
            if isinstance(part, bytes):
                at = self._word(at, part)
            elif part[0] == "optional":
                end = self._sequence(at, part[1])
                out = self._state()
                self.free[end].add(out)
                self.free[at].add(out)
                at = out
            elif part[0] == "any":
                out = self._state()
                for k in range(part[2] + 1):
                    if k >= part[1]:
                        self.free[at].add(out)
                    if k < part[2]:
                        at = self._word(at, ANY)
                at = out
            else:
                out = self._state()
                for words in part[1]:
                    self.free[self._sequence(at, words)].add(out)
                at = out
        return at

    def _closure(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()] - found:
                found.add(s)
                todo.append(s)
        return frozenset(found)

    def step(self, states: frozenset, word: bytes):
        """The next subset state and the templates that end there."""
        known = self.steps.setdefault(states, {})
        if word not in known:
            explicit = any(word in self.moves[s] for s in states)
            key = word if explicit else ANY  # words that no move names all lead to the same place
            if key not in known:
                to = self._closure({t for s in states for w in {word, ANY} & self.moves[s].keys() for t in self.moves[s][w]})
                known[key] = (to, [self.accepts[s] for s in sorted(to & self.accepts.keys())])
            return known[key]
        return known[word]

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, past the last word) of all places; the longest for each template and start."""
        out = []
        for i in [i for i, w in enumerate(words) if w in self.begins]:
            states, longest = self.first, {}
            for j in range(i, len(words)):
                states, ended = self.step(states, words[j])
                for t in ended:
                    longest[t] = j + 1
                if not states:
                    break
            out += [(t, i, e) for t, e in longest.items()]
        return out


FOUND = "n_words long, matches array<struct<label:string,base:boolean,start:long,stop:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Of each document: id, ``n_words`` and ``matches`` (label, whether a base phrase, first word, past the last word)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        automaton = Automaton(templates)
        base = [t.base for t in templates]
        for batch in slices(batches):
            counts, found = [], []
            for text in as_bytes(batch["text"]):
                words = words_of(text)
                counts.append(len(words))
                found.append([{"label": automaton.labels[t], "base": base[t], "start": a, "stop": b} for t, a, b in automaton.places(words)])
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "n_words": pa.array(counts, pa.int64()), "matches": pa.array(found, kind)})

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {FOUND}").withColumnRenamed("id", id_col)


def pattern(markup: str) -> str:
    """The template as a regular expression over words that each have one space behind, for other engines to check against."""

    def of(parts) -> str:
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += re.escape(part.decode()) + " "
            elif part[0] == "optional":
                out += f"(?:{of(part[1])})?"
            elif part[0] == "any":
                out += f"(?:[^ ]+ ){{{part[1]},{part[2]}}}"
            else:
                out += "(?:" + "|".join(of(x) for x in part[1]) + ")"
        return out

    return "(?:^| )" + of(parse(markup))


__all__ = ["TEMPLATES", "WORD", "Automaton", "Template", "parse", "pattern", "scan"]
