"""Licence scans: phrases, and template markup compiled to token automata.

Words: A-Z are lowered, and runs of ASCII letters, digits and all non-ASCII characters are
words. Phrases are found wherever their words stand consecutively.

A template is wording with optional regions between <<beginOptional>> and <<endOptional>>
(they may nest) and replaceable regions <<var;limit=N>> of up to N words. It compiles to
an automaton over words: a state for each place of the wording, free moves over optional
regions, and counted loops for replaceable ones. A text is accepted where all mandatory
words follow each other exactly, with only those regions free. Automata start at every
place of a template's first words; the first accepting end from a start counts.

Score: the share of the text's words that lie in an accepted place or phrase.

Null and empty texts have no words, no labels and score 0; long texts are read whole;
repeated rows are scanned alike; only the id and text columns are read.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.licence_templates import PHRASES, TEMPLATES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MARKUP = re.compile(r"<<(beginOptional|endOptional|var)(?:;limit=(\d+))?>>")
SCHEMA = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(LOWER))


class Automaton:
    """States are places 0..len(steps); a step is a word, or a bound of free words; skips are free moves."""

    def __init__(self, template: str):
        self.steps: list[str | int] = []
        self.skips: dict[int, list[int]] = {}
        opened, at = [], 0
        for mark in [*MARKUP.finditer(template), None]:
            self.steps += words_of(template[at : mark.start() if mark else len(template)])
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                opened.append(len(self.steps))
            elif mark[1] == "endOptional":
                self.skips.setdefault(opened.pop(), []).append(len(self.steps))
            else:
                self.steps.append(int(mark[2] or 20))
        #: Mandatory words that every accepted text begins with.
        self.anchor = []
        for k, step in enumerate(self.steps):
            if isinstance(step, int) or k in self.skips:
                break
            self.anchor.append(step)
        if len(self.anchor) < 3:
            raise ValueError("a template begins with at least three mandatory words")

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        """states with what free moves reach: place -> words that its replaceable region has used (least)."""
        todo = list(states.items())
        while todo:
            place, used = todo.pop()
            more = [(x, 0) for x in self.skips.get(place, ())]
            if place < len(self.steps) and isinstance(self.steps[place], int):
                more.append((place + 1, 0))
            for x, u in more:
                if states.get(x, 1 << 30) > u:
                    states[x] = u
                    todo.append((x, u))
        return states

    def end(self, words: list[str], start: int) -> int | None:
        """The first accepting end of a match from start, or None."""
        states, last = self.closure({0: 0}), len(self.steps)
        for at in range(start, len(words) + 1):
            if last in states:
                return at
            if not states or at == len(words):
                return None
            word, after = words[at], {}
            for place, used in states.items():
                step = self.steps[place]
                if step == word:
                    after[place + 1] = 0
                elif isinstance(step, int) and used < step:
                    after[place] = min(after.get(place, 1 << 30), used + 1)
            states = self.closure(after)
        return None


@cache
def compiled() -> tuple:
    """Automata, and one pattern of all anchors and phrases over words joined by blanks."""
    automata = [(label, Automaton(text)) for label, text in TEMPLATES]
    anchors: dict[str, list[int]] = {}
    for k, (_, automaton) in enumerate(automata):
        anchors.setdefault(" ".join(automaton.anchor[:3]), []).append(k)
    return automata, anchors, {phrase: tuple(phrase.split()) for phrase, _ in PHRASES}


def places(joined: str, phrase: str) -> list[int]:
    """Word places where a phrase stands in words joined by (and between) blanks."""
    out, wanted, at, seen, count = [], f" {phrase} ", 0, 0, 0
    while (at := joined.find(wanted, at)) >= 0:
        count += joined.count(" ", seen, at)
        seen = at
        out.append(count)
        at += 1
    return out


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = words_of(text)
    joined = f" {' '.join(words)} "
    automata, anchors, phrases = compiled()
    base, starts, inside = set(), [], []
    for phrase, label in PHRASES:
        if found := places(joined, phrase):
            base.add(label)
            starts += found
            inside += [(x, x + len(phrases[phrase])) for x in found]
    labels = set(base)
    for anchor, those in anchors.items():
        for start in places(joined, anchor):
            for k in those:
                label, automaton = automata[k]
                if (end := automaton.end(words, start)) is not None:
                    labels.add(label)
                    inside.append((start, end))
    score = 0.0
    if inside:
        hit = np.zeros(len(words), bool)
        for a, b in inside:
            hit[a:b] = True
        score = float(hit.mean())
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for batch in batches:
            found = [scan(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text]).mapInArrow(run, SCHEMA.format(dict(docs.dtypes)[id_col]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


QUERIES = {"op4_licence_templates": op4}
