r"""License scan by matching of template markup.

A template is wording with ``<<beginOptional>>`` ... ``<<endOptional>>`` regions, which may be absent,
and ``<<var;match=REGEX;max=N>>`` regions, which stand for up to N words that each match REGEX.  It is
compiled into an automaton over words; a text carries the template's label if the automaton accepts
some run of its words, that is if all mandatory wording stands there exactly, in order.  Case,
punctuation and line breaks don't count.  Beside templates there are phrases, which are plain runs of words.

Nulls and texts without words have no labels.  Columns of the input with the names of those added
are replaced; repeated rows are judged alike.  Hashes of 64 bits find the places; automata compare words.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernel as K
from .common import WORD_RE, small_batches, sql_fold, table, without

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_V = "<<var;match=[0-9]+;max=1>>"
TEMPLATES = [
    ("gpl-3.0", "Licensed under the GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<beginOptional>>; either<<endOptional>> version 3<<beginOptional>> of the License<<endOptional>><<beginOptional>>, or (at your option) any later version<<endOptional>>"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>; either<<endOptional>> version 3 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>"),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>; either<<endOptional>> version 2 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use this file except in compliance with the License<<endOptional>>"),
    ("mit", "Released under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice<<beginOptional>> (including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of <<var;match=.+;max=4>>"),
    ("isc", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "<<beginOptional>>3<<endOptional>> Neither the name of <<var;match=.+;max=8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", f"Licensed under<<beginOptional>> a<<endOptional>> <<beginOptional>>Creative Commons <<endOptional>>CC BY-NC<<beginOptional>> {_V}<<endOptional>><<beginOptional>> {_V}<<endOptional>>"),
    ("cc-by-sa", f"Licensed under<<beginOptional>> a<<endOptional>> <<beginOptional>>Creative Commons <<endOptional>>CC BY-SA<<beginOptional>> {_V}<<endOptional>><<beginOptional>> {_V}<<endOptional>>"),
    ("cc-by-4.0", "Licensed under<<beginOptional>> a<<endOptional>> <<beginOptional>>Creative Commons <<endOptional>>CC BY 4.0"),
    ("cc0-1.0", "<<beginOptional>>Creative Commons <<endOptional>>CC0 1.0 Universal"),
]

_UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return re.findall(WORD_RE, (text or "").translate(_UP))


def parse(template: str) -> list:
    """The template as a list of words, ("opt", list) and ("var", regex, most words)."""
    stack: list = [[]]
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<beginOptional>>":
            stack.append([])
        elif part == "<<endOptional>>":
            inner = stack.pop()
            if not stack:
                raise ValueError("endOptional without beginOptional")
            stack[-1].append(("opt", inner))
        elif part.startswith("<<var"):
            given = dict(x.split("=", 1) for x in part[2:-2].split(";")[1:])
            stack[-1].append(("var", given.get("match", ".+"), int(given.get("max", 1))))
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            stack[-1] += words(part)
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class Automaton:
    """A nondeterministic automaton over words.  Edges: state -> [(word, regex or None for any move, next state)]."""

    def __init__(self, label: str, template: str):
        self.label, self.edges, self.n = label, {}, 1
        self.final = self._add(parse(template), 0)
        self.starts = {w for w, _, _ in self._moves({0})}
        self.pairs = {(w, x) for w, _, to in self._moves({0}) for x, _, _ in self._moves({to})}  # the first two words; None: any
        self.pairs |= {(w, None) for w, _, to in self._moves({0}) if self.final in self._closure({to})}
        if None in self.starts or self.final in self._closure({0}):
            raise ValueError(f"{label}: a template must start with fixed words")

    def _new(self) -> int:
        self.n += 1
        return self.n - 1

    def _add(self, parts: list, at: int) -> int:
        for x in parts:
            to = self._new()
            if isinstance(x, str):
                self.edges.setdefault(at, []).append((x, None, to))
            elif x[0] == "opt":
                end = self._add(x[1], at)
                self.edges.setdefault(end, []).append((None, None, to))
                if end != at:
                    self.edges.setdefault(at, []).append((None, None, to))
            else:
                test, here = re.compile(x[1]), at
                for _ in range(x[2]):
                    there = self._new()
                    self.edges.setdefault(here, []).append((None, test, there))
                    self.edges.setdefault(there, []).append((None, None, to))
                    here = there
            at = to
        return at

    def _closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for word, test, to in self.edges.get(todo.pop(), ()):
                if word is None and test is None and to not in out:
                    out.add(to)
                    todo.append(to)
        return out

    def _moves(self, states: set[int]):
        return [(w, t, to) for s in self._closure(states) for w, t, to in self.edges.get(s, ()) if w is not None or t is not None]

    def accepts_at(self, text: list[str], at: int) -> int:
        """The end of the longest accepted run of words from ``at``, or -1."""
        states, best = {0}, -1
        for i in range(at, len(text) + 1):
            states = self._closure(states)
            if self.final in states:
                best = i
            if i == len(text):
                break
            states = {to for w, t, to in self._moves(states) if (text[i] == w if w is not None else t.fullmatch(text[i]))}
            if not states:
                break
        return best


def regex(parts: list) -> str:
    """RE2 text of a parsed template, over words that each follow a space."""
    out = ""
    for x in parts:
        if isinstance(x, str):
            out += " " + re.escape(x)
        elif x[0] == "opt":
            out += f"(?:{regex(x[1])})?"
        else:
            out += f"(?: (?:{x[1].replace('.', '[^ ]')})){{1,{x[2]}}}"
    return out


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    matches: the templates' runs (label, start, end), in words.  score: 1 for a text that a template
    accepts, 0.5 for one that only names a license by a phrase, else 0.
    """
    small_batches(docs.sparkSession)
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    docs = without(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:int,end:int>>").fields])
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

    def f(batches):
        tabs = K.tables(K.WORD)
        seqs = [(np.array([K.word_hash(w) for w in words(p)], dtype=np.uint64), label) for p, label in phrases.items()]
        automata = [Automaton(*x) for x in templates]
        starts = np.array(sorted({K.word_hash(w) for a in automata for w in a.starts}), dtype=np.uint64)
        pairs = {(w, x) for a in automata for w, x in a.pairs}
        loose = np.array([K.word_hash(w) for w, x in pairs if x is None], dtype=np.uint64)
        tight = K.mix(np.array([K.word_hash(w) for w, x in pairs if x is not None], dtype=np.uint64)) + np.array([K.word_hash(x) for _, x in pairs if x is not None], dtype=np.uint64)
        by = {}
        for a in automata:
            for w in a.starts:
                by.setdefault(w, []).append(a)
        tests = K.Lookup(np.concatenate([starts, *[s[:1] for s, _ in seqs]]))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi, data, offs in K.chunks(column):
                w = K.Words(data, offs, tabs)
                many = np.diff(w.first)
                base, runs = {}, {}
                at, k = tests.find(w.hash)  # the words with which a phrase or a template may begin
                for s, label in seqs:
                    p = at[w.hash[at] == s[0]]
                    p = p[p + len(s) <= len(w.hash)]
                    p = p[w.doc[p] == w.doc[p + len(s) - 1]]
                    for j in range(1, len(s)):
                        p = p[w.hash[p + j] == s[j]]
                    for x in p.tolist():
                        base.setdefault(int(w.doc[x]), []).append((x - int(w.first[w.doc[x]]), label))
                p = at[np.isin(w.hash[at], starts)]
                follow = w.hash[np.minimum(p + 1, len(w.hash) - 1)] if len(p) else w.hash[:0]
                p = p[np.isin(K.mix(w.hash[p]) + follow, tight) | np.isin(w.hash[p], loose)]
                for d in np.unique(w.doc[p]).tolist():
                    own = p[w.doc[p] == d]
                    a, z = int(w.first[d]), int(w.first[d + 1])
                    tokens = None
                    for x in own.tolist():
                        first = bytes(data[w.start[x] : w.end[x]]).decode().translate(_UP)
                        for m in by.get(first, ()):
                            if tokens is None:
                                tokens = [bytes(data[i:j]).decode().translate(_UP) for i, j in zip(w.start[a:z].tolist(), w.end[a:z].tolist())]
                            if (end := m.accepts_at(tokens, x - a)) >= 0:
                                runs.setdefault(d, []).append({"label": m.label, "start": x - a, "end": end})
                rows = [[] for _ in range(7)]
                for d in range(len(many)):
                    b, r = base.get(d), runs.get(d, [])
                    names = sorted({x for _, x in b}) if b else []
                    rows[0].append(len(b) if b else 0)
                    rows[1].append(min(b)[0] if b else None)
                    rows[2].append(max(b)[0] if b else None)
                    rows[3].append(",".join(names))
                    rows[4].append(",".join(sorted({*names, *(x["label"] for x in r)})) if r else rows[3][-1])
                    rows[5].append(1.0 if r else 0.5 if b else 0.0)
                    rows[6].append(r)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(many, pa.int64()), *(pa.array(x, kind) for x, (_, kind) in zip(rows, kinds[1:]))], [*batch.schema.names, *(c for c, _ in kinds)])

    return docs.mapInArrow(K.tidy(f), schema)


def op2_license_templates(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    places = " UNION ALL ".join(f"SELECT doc_id, s, '{label}' AS label FROM p WHERE list_slice(w, s + 1, s + {len(words(x))}) = {words(x)!r}" for x, label in PHRASES.items())
    marks = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM d WHERE regexp_matches(line, '{regex(parse(t))} ')" for label, t in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM (SELECT doc_id, regexp_extract_all({sql_fold("coalesce(text, '')")}, '{WORD_RE}') AS w FROM documents)),
p AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1)) AS s FROM d WHERE len(w) > 0),
b AS ({places}),
t AS ({marks}),
x AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b GROUP BY doc_id),
y AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM t) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN doc_id IN (SELECT doc_id FROM t) THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""


SQL = _sql()
