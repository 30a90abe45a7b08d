r"""License scans by template-markup matching.

A template is wording with marked regions: `<<beginOptional>>...<<endOptional>>` may be missing, `<<var;words=a-b>>` stands for
any a to b words. Templates are compiled into one automaton over words; all starts of a batch walk through it together, word
by word, and a template is accepted where its mandatory wording stands exactly. A text may hold many places of a template; of
the ends that a place can have, the last counts.

Words are looked up by their bytes. An automaton takes up to 62 templates; more make several, which all texts go through.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased, so case, white space and punctuation don't matter.

Defined results: null or empty texts have no words and no places; repeated rows and null ids stay rows of their own; texts
of any length are scanned whole; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .common import documents

TABLE = T.table_of(b"0123456789abcdefghijklmnopqrstuvwxyz", lower=True)
#: label, template. The first three are plain phrases, whose places are counted.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
TEMPLATES = (
    ("apache-2.0", "licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc by nc <<var;words=0-2>>"),
    ("gpl-3.0", "gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version 3"),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "<<beginOptional>>released<<endOptional>> under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction"),
    ("reserved", "copyright <<beginOptional>>c<<endOptional>> <<var;words=0-6>> all rights reserved"),
    # Whole texts of public licenses
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
     "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any "
     "kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;words=1-8>> be liable for "
     "any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> "
     "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form "
     "must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
     "<<beginOptional>><<beginOptional>>3<<endOptional>> neither the name of <<var;words=1-8>> nor the names of its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission<<endOptional>> this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
     "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc-text", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
     "notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
     "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
     "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
)
#: Templates in an automaton, one bit each.
MOST = 62
_TAG = re.compile(r"<<\s*(beginOptional|endOptional|var)\s*;?([^>]*)>>")
_WORD = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")


def parse(template: str) -> list:
    """A list of words, ("var", least, most) and ("optional", list)."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_TAG.finditer(template), None]:
        stack[-1] += _WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), template[at : m.start() if m else None]))
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            part = stack.pop()
            stack[-1].append(("optional", part))
        else:
            n = re.search(r"words=(\d+)-(\d+)", m[2])
            if not n:
                raise ValueError("a var needs words=least-most")
            stack[-1].append(("var", int(n[1]), int(n[2])))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


@dataclass
class Automaton:
    """step[state, class of the word] is the next state; 0 is the end, 1 the start. accepts[state] has a bit for each template."""

    words: list[bytes]  # the known words; their classes are 1 and on, any other word's is 0
    step: np.ndarray
    accepts: np.ndarray


def compiled(templates: tuple[tuple[str, str], ...]) -> Automaton:
    if len(templates) > MOST:
        raise ValueError(f"at most {MOST} templates in an automaton")
    edges: list[list[tuple[str | None, int]]] = []  # of each state: (word, or None for any, next)
    skips: list[list[int]] = []  # moves without a word
    final: dict[int, int] = {}

    def new() -> int:
        edges.append([])
        skips.append([])
        return len(edges) - 1

    def add(parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, str):
                to = new()
                edges[at].append((p, to))
            elif p[0] == "optional":
                to = add(p[1], at)
                after = new()
                skips[to].append(after)
                skips[at].append(after)
                to = after
            else:
                ends = [at] if not p[1] else []
                to = at
                for i in range(p[2]):
                    nxt = new()
                    edges[to].append((None, nxt))
                    to = nxt
                    if i + 1 >= p[1]:
                        ends.append(to)
                after = new()
                for e in ends:
                    skips[e].append(after)
                to = after
            at = to
        return at

    root = new()
    for i, (_, template) in enumerate(templates):
        start = new()
        skips[root].append(start)
        final[add(parse(template), start)] = i

    def closed(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    words = sorted({w for e in edges for w, _ in e if w is not None})
    first = closed({root})
    if any(w is None for s in first for w, _ in edges[s]) or first & set(final):
        raise ValueError("a template must begin with a word and hold one")
    number, todo, rows = {frozenset(): 0, first: 1}, [first], {0: [0] * (len(words) + 1)}
    while todo:
        at = todo.pop()
        row = []
        for c in [None, *words]:
            to = closed({t for s in at for w, t in edges[s] if w is None or w == c})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows[number[at]] = row
    accepts = np.zeros(len(number), np.int64)
    for states, i in number.items():
        accepts[i] = sum(1 << final[s] for s in states & set(final))
    return Automaton([w.encode() for w in words], np.array([rows[i] for i in range(len(number))], np.int32), accepts)


def places(auto: Automaton, words: pa.DictionaryArray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the words of a run of rows: the places of the templates as row, start (from 0), template, number of words."""
    known = pa.array(auto.words, words.dictionary.type)
    kind = pc.fill_null(pc.index_in(words.dictionary, known), -1).to_numpy(zero_copy_only=False)
    kind = (kind + 1)[words.indices.to_numpy()]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(auto.step[1][kind])
    end = bounds[row[start] + 1]
    found: list[np.ndarray] = []
    state, at = np.ones(len(start), np.int32), start.copy()
    while len(start):
        state = auto.step[state, kind[at]]
        at = at + 1
        bits = auto.accepts[state]
        for i in np.flatnonzero(bits).tolist():
            found += [(start[i], t, at[i] - start[i]) for t in range(MOST) if bits[i] >> t & 1]
        on = (state > 0) & (at < end)
        start, state, at, end = start[on], state[on], at[on], end[on]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    s, t, n = np.array(found, np.int64).T
    order = np.lexsort((n, t, s))
    s, t, n = s[order], t[order], n[order]
    last = np.append((s[1:] != s[:-1]) | (t[1:] != t[:-1]), True)
    s, t, n = s[last], t[last], n[last]
    return row[s], s - bounds[row[s]], t, n


def from_table(templates: DataFrame) -> tuple[tuple[str, str], ...]:
    """The templates of a table (label, template), for scan(). They come to the driver: such tables hold some hundred licenses."""
    return tuple((r["label"], r["template"]) for r in templates.select("label", "template").distinct().orderBy("label", "template").collect())


SCANNED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("template", pa.int32())])))])


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = BASE + TEMPLATES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, places: array of (start, n, template), by start and template; template is the
    number in `templates`."""
    autos = [compiled(templates[i : i + MOST]) for i in range(0, len(templates), MOST)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.parts(batches):
            for at, data, offsets in T.runs(b.column(1)):
                starts, ends, _, bounds = T.words(data, offsets, table=TABLE)
                words = T.spelled(data, starts, ends, lower=True)
                found = [places(auto, words, bounds) for auto in autos]
                row, start, t, n = (np.concatenate(x) for x in zip(*((r, s, k + MOST * i, m) for i, (r, s, k, m) in enumerate(found)), strict=True))
                if len(autos) > 1:
                    order = np.lexsort((t, start, row))
                    row, start, t, n = row[order], start[order], t[order], n[order]
                ends = np.searchsorted(row, np.arange(len(bounds))).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(start), pa.array(n), pa.array(t.astype(np.int32))], names=["start", "n", "template"])
                cols = [b.column(0).slice(at, len(bounds) - 1), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(ends), each)]
                yield pa.RecordBatch.from_arrays(cols, schema=SCANNED)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(of, "doc_id long, n_words long, places array<struct<start:long,n:long,template:int>>")


def _joined(labels):
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = BASE + TEMPLATES
    names = F.array(*(F.lit(label) for label, _ in every))
    base = F.filter("places", lambda p: p["template"] < len(BASE))
    name = lambda p: F.get(names, p["template"])
    out = scan(documents(spark, sf_dir)).withColumn("base", base)
    labels = F.transform("places", name)
    # The longest place says how sure the scan is: n words count for n / (n + 2).
    longest = F.coalesce(F.array_max(F.transform("places", lambda p: p["n"])), F.lit(0))
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda p: p["start"])).alias("first_word"),
                      F.array_max(F.transform("base", lambda p: p["start"])).alias("last_word"), _joined(F.transform("base", name)).alias("base_labels"),
                      _joined(labels).alias("labels"), (longest / (longest + 2)).alias("score"))


def _regex(parts: list) -> str:
    """The expression for texts whose every word has a space on either side."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += f" {re.escape(p)} "
        elif p[0] == "optional":
            out += f"(?:{_regex(p[1])})?"
        else:
            out += f"(?: [^ ]+ ){{{p[1]},{p[2]}}}"
    return out


def _sql() -> str:
    whole = [(label, _regex(parse(t))) for label, t in BASE + TEMPLATES]
    has = ", ".join(f"CASE WHEN regexp_matches(s, '{r}') THEN '{label}' END" for label, r in whole)
    based = ", ".join(f"CASE WHEN regexp_matches(s, '{r}') THEN '{label}' END" for label, r in whole[: len(BASE)])
    most = ", ".join(f"coalesce(list_max(list_transform(regexp_extract_all(s, '{r}'), lambda x: len(string_split(trim(x), '  ')))), 0)" for _, r in whole)
    is_at = " OR ".join(f"({' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(t.split()))})" for _, t in BASE)
    tidy = "coalesce(array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ','), '')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS s, list_filter(generate_series(1, len(w)), lambda i: {is_at}) AS starts FROM d),
f AS (SELECT *, greatest({most}) AS longest FROM e)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, starts[1] - 1 AS first_word, starts[-1] - 1 AS last_word,
  {tidy.format(based)} AS base_labels, {tidy.format(has)} AS labels, longest / (longest + 2) AS score
FROM f
"""


QUERIES, ORACLES = {"op2_license_scan": op2_license_scan}, {"op2_license_scan": _sql()}
