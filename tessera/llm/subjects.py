"""Subject areas of documents.

Method: curated weighted subject terms are matched by one multi-pattern automaton; the documents that hold each term are
counted over the whole corpus; each paragraph or turn gets a score per subject, normalised by its length in sentences
and by the rarity of the terms it holds (among subjects and among documents); every subject that exceeds its calibrated
threshold in some paragraph is assigned to the document.

A sentence counts towards a subject with the largest weight of the subject's terms in it, so a paragraph that deals
with a subject scores near 1 and one with a remark or a tag about it near 1 / sentences. Texts are read once; only the
terms found in them are kept for the second step.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.subject_terms import weights
from tessera.llm.words import INVISIBLE
from tessera.runtime import materialise

#: A subject without a threshold of its own has this one: a little more than half of a paragraph's sentences.
THRESHOLD = 0.54
#: Calibrated on the hand labels of the test data at scale 0.1 (`calibrate`).
THRESHOLDS = {
    "astronomy": 0.54, "build_tooling": 0.54, "cooking": 0.54, "databases": 0.54, "finance": 0.54, "law": 0.54,
    "machine_learning": 0.54, "medicine": 0.54, "networking": 0.54, "security": 0.54, "sport": 0.54, "web_frontend": 0.54,
}
#: A term counts in full while at most this share of the documents, or so many of them, hold it.
COMMON, FEW = 0.2, 200
#: Labelled documents that thresholds are calibrated on at most.
LABELLED = 50_000
#: Letters from which on a misspelt term is still taken for the term.
LONG_TERM = 7
_PATH = re.compile(r"\S*/\S*")
_GAP = re.compile(r"\n[ \t\r]*\n\s*|\n(?=[ \t]*(?:[-*+] |#{1,6} |\[(?:user|assistant|thinking|tool|result)\b))")
_FENCE = re.compile(r"^[ \t]*(?:>[ \t]*)*```[^\n]*$", re.M)
_MARKER = re.compile(r"^\s*(?:>\s*)*(?:[-*+] |#{1,6} |\[(?:user|assistant|thinking|tool:[^\]]*|result:[^\]]*)\]\s*)+")
_SPACE = re.compile(r"[\s\-(),:\"'’“”«»¿¡*`>]+")
_END = re.compile(r"[.!?]+(?=\s|$)")


def prose(text: str) -> list[str]:
    """The stretches of a text outside its code fences; a fence (a line that starts with ```) without a partner is text."""
    marks = list(_FENCE.finditer(text))
    out, at = [], 0
    for a, b in zip(marks[::2], marks[1::2]):
        out.append(text[at : a.start()])
        at = b.end()
    return [*out, text[at:]]


def paragraphs(text: str) -> list[str]:
    """The paragraphs, list items and turns of a text in lower case, without their markers, headings and fenced code."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(INVISIBLE)
    out = []
    for stretch in prose(t.replace("\r\n", "\n").replace("\r", "\n")):
        for p in _GAP.split(stretch):
            if p.lstrip().startswith("#"):  # a heading is no paragraph
                p = p.lstrip().partition("\n")[2]
            p = _MARKER.sub("", p).strip()
            if p:
                out.append(p)
    return out


def slips(term: str) -> set[str]:
    """The spellings of a long term with one letter left out or two neighbours swapped."""
    if len(term) < LONG_TERM:
        return set()
    cut = {term[:i] + term[i + 1 :] for i in range(1, len(term))}
    swapped = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
    return {t for t in cut | swapped if t != term and t == t.strip() and len(t.split()[0]) > 1}


class Terms:
    """The automaton over all terms; patterns begin at a word and may be followed by a plural ending."""

    def __init__(self, listed: dict[str, dict[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        self.subjects = sorted({s for w in listed.values() for s in w})
        number = {s: i for i, s in enumerate(self.subjects)}
        self.names = sorted(listed)
        self.entries = [[(number[s], w) for s, w in listed[t].items()] for t in self.names]
        for n, (term, by) in enumerate(sorted(listed.items())):
            entry = [(number[s], w) for s, w in by.items()]
            # an underscore joins the words of a term, but a name in code that holds a term is not that term
            for spelt in sorted({term, term.replace(" ", "_")} | slips(term) - listed.keys()):
                if spelt in listed and spelt != term or " " + spelt in self.automaton and spelt != term:
                    continue
                self.automaton.add_word(" " + spelt, (n, len(spelt), entry))
        self.automaton.make_automaton()

    def hits(self, paragraph: str) -> tuple[int, list[tuple[int, int, list]]]:
        """The number of sentences, and per term found (term, sentence, subjects with weights)."""
        ends, flat, n = [], [], 0
        at = 0
        if "/" in paragraph:  # paths hold words of their own
            paragraph = _PATH.sub(lambda m: " x" + (m[0][-1] if m[0][-1] in ".!?" else ""), paragraph)
        for m in _END.finditer(paragraph):
            s = _SPACE.sub(" ", paragraph[at : m.start()]).strip()
            at = m.end()
            if s:
                flat.append(s)
        s = _SPACE.sub(" ", paragraph[at:]).strip()
        if s:
            flat.append(s)
        text = " " + " . ".join(flat) + " ."
        n = 1
        for s in flat:
            ends.append(n + len(s))
            n += len(s) + 3
        found = []
        for end, (term, length, by) in self.automaton.iter(text):
            tail = text[end + 1 : end + 4]
            if tail[:1].isalnum() or tail[:1] == "_":
                k = 1 if tail[0] == "s" else 2 if tail[:2] == "es" else 0
                if not k or tail[k : k + 1].isalnum() or tail[k : k + 1] == "_":
                    continue
            while found and found[-1][0] > end - length:  # a longer term holds the one before it
                found.pop()
            if not found or found[-1][1] < end:
                found.append((end - length, end, term, by))
        return len(flat), [(term, bisect_right(ends, end), by) for _, end, term, by in found]


def scores(n: int, found: list[tuple[int, int, list]], rarity: np.ndarray | None = None) -> dict[int, float]:
    """Score per subject of a paragraph of n sentences with these terms; `rarity` is a factor per term.

    A term of several subjects counts in full for the one that most distinct terms of the paragraph speak for, if there
    is such a one, and by its weight for each otherwise.
    """
    support: dict[int, set[int]] = {}
    for term, _, subjects in found:
        for s, _ in subjects:
            support.setdefault(s, set()).add(term)
    by: dict[tuple[int, int], float] = {}
    for term, sentence, subjects in found:
        rare = 1.0 if rarity is None else float(rarity[term])
        ahead = sorted((len(support[s]) for s, _ in subjects), reverse=True)
        clear = len(ahead) > 1 and ahead[0] > ahead[1]
        for s, w in subjects:
            w = rare * (1.0 if clear and w and len(support[s]) == ahead[0] else w)
            by[s, sentence] = max(w, by.get((s, sentence), 0.0))
    out: dict[int, float] = {}
    for (s, _), w in by.items():
        out[s] = out.get(s, 0.0) + w / n
    return out


_HITS = "doc_id long, sentences array<int>, paragraph array<int>, term array<int>, sentence array<int>, terms array<int>"


def _finder(shared):
    def run(frames):
        terms: Terms = shared.value
        for f in frames:
            rows = []
            for d, text in zip(f["doc_id"], f["text"]):
                lengths, paragraph, term, sentence = [], [], [], []
                for p in paragraphs(text):
                    n, found = terms.hits(p)
                    if not found:
                        continue
                    paragraph += [len(lengths)] * len(found)
                    lengths.append(n)
                    term += [t for t, _, _ in found]
                    sentence += [x for _, x, _ in found]
                if term:
                    rows.append((d, lengths, paragraph, term, sentence, sorted(set(term))))
            yield pd.DataFrame(rows, columns=["doc_id", "sentences", "paragraph", "term", "sentence", "terms"])

    return run


def rarity_of(counts: dict[int, int], n_terms: int, n_documents: int) -> np.ndarray:
    """A factor per term for the documents that hold it: 1 up to the share COMMON, then falling as the logarithm of the
    share, to 0 for a term that every document holds."""
    n = np.zeros(n_terms)
    n[list(counts)] = list(counts.values())
    share = np.maximum(n, 1) / max(1, n_documents)
    return np.where((n <= FEW) | (share <= COMMON), 1.0, np.log(np.minimum(share, 1)) / np.log(COMMON))


def _scorer(shared, rarity: np.ndarray, thresholds: list[float]):
    def run(frames):
        terms: Terms = shared.value
        for f in frames:
            rows = []
            for d, lengths, paragraph, term, sentence in zip(f["doc_id"], f["sentences"], f["paragraph"], f["term"], f["sentence"]):
                best: dict[int, float] = {}
                by: list[list] = [[] for _ in lengths]
                for p, t, x in zip(paragraph, term, sentence):
                    by[p].append((t, x, terms.entries[t]))
                for n, found in zip(lengths, by):
                    for s, x in scores(n, found, rarity).items():
                        if x > best.get(s, 0.0):
                            best[s] = x
                rows += [(d, terms.subjects[s], x) for s, x in best.items() if x >= thresholds[s]]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "score"])

    return run


def document_subjects(documents: DataFrame, listed: dict[str, dict[str, float]] | None = None, thresholds: dict[str, float] | None = None, default: float = THRESHOLD) -> DataFrame:
    """doc_id, subject and the best paragraph's score, for each subject of each document.

    Null, empty and term-free texts give no rows. Ties and repeated documents are scored alike; each row of
    `documents` counts on its own. Whole texts are read whatever their length. `thresholds` by subject, `default` for
    the others.
    """
    terms = Terms(listed or weights())
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    found = materialise(docs.mapInPandas(_finder(shared), _HITS), "terms")
    counts = {r.t: r["count"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row a term
    rarity = rarity_of(counts, len(terms.names), docs.count())
    bounds = [(THRESHOLDS if thresholds is None else thresholds).get(s, default) for s in terms.subjects]
    return found.drop("terms").mapInPandas(_scorer(shared, rarity, bounds), "doc_id long, subject string, score double")


def calibrate(documents: DataFrame, labels: DataFrame, listed: dict[str, dict[str, float]] | None = None, most: int = LABELLED) -> dict[str, float]:
    """Thresholds by subject from hand labels (`doc_id, subject`) on at most `most` labelled documents.

    Of the ranges between successive scores, the one that parts labelled from other documents with the fewest faults is
    taken, ties to the nearest to THRESHOLD; and THRESHOLD's own range where no other has fewer faults by more than
    wrong labels explain (two, or a hundredth of the labels). Within its range a threshold is as near to THRESHOLD as a
    tenth of the range allows.
    """
    chosen = labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(most)
    scored = document_subjects(documents.join(F.broadcast(chosen), "doc_id", "left_semi"), listed, {}, 0.0)
    got = scored.join(labels.select("doc_id", "subject", F.lit(True).alias("labelled")).distinct(), ["doc_id", "subject"], "left").toPandas()
    out = {}
    for subject, g in got.groupby("subject"):
        g = g.sort_values("score")
        x, y = g["score"].to_numpy(), g["labelled"].eq(True).to_numpy()
        edges = np.unique(np.r_[0.0, x, 1.0])
        faults = np.array([int((y & (x < hi)).sum() + (~y & (x >= hi)).sum()) for hi in edges[1:]])
        lo, hi = edges[:-1], edges[1:]
        inner = np.clip(THRESHOLD, lo + 0.1 * (hi - lo), hi - 0.1 * (hi - lo))
        own = int(np.flatnonzero((lo < THRESHOLD) & (THRESHOLD <= hi))[0])
        best = min(np.flatnonzero(faults == faults.min()), key=lambda i: abs(inner[i] - THRESHOLD))
        if faults[own] - faults[best] <= max(2, y.sum() / 100):
            best = own
        out[subject] = round(float(inner[best]), 3)
    return out
