"""Toxicity: a learned lexicon matched with misspellings, and scored by the words around each match.

The lexicon, whole terms and stems, is learned from a bounded sample of labelled documents, counted in Spark. Its trie is intersected with
the Levenshtein automata of the terms: the states of one deterministic automaton are sets of trie nodes with the edits
spent, so all words of a batch go through one table side by side. Each match weighs what its kind (exact or misspelt)
is worth by the labels; a document's features tell matches in quotation marks from others, and matches with another in
the window of words around from lone ones. A logistic model of the features, fitted out of fold, gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import textbytes as tb
from gneiss.llm.work import written

#: Documents that labels are learned from, at most.
SAMPLE = 5000
#: Tasks that share the work on them.
TASKS = 12
TERMS = 120
WINDOW = 8
QUOTES = "\"'«»‘’“”„‚‹›"


def allowed(term: str, stem: bool) -> int:
    """Edits within which a word is taken for a misspelt term."""
    return (len(term) >= 6) if stem else 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class Automaton:
    """Accepts words within allowed() of a term, or that begin so for a stem. run() gives each word's best (term, edits)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        letters = sorted({c for t, _ in terms for c in t})
        self.classes = {c: i + 1 for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        ends: list[dict[int, int]] = [{}]  # at a node: term's number
        reach: list[int] = [0]  # most edits of any term below
        for number, (term, stem) in enumerate(terms):
            node = 0
            reach[0] = max(reach[0], allowed(term, stem))
            for c in term:
                k = self.classes[c]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    ends.append({})
                    reach.append(0)
                node = children[node][k]
                reach[node] = max(reach[node], allowed(term, stem))
            ends[node][number] = allowed(term, stem)

        def closed(items: dict[int, int], done: dict[int, int]) -> tuple[frozenset, frozenset]:
            """Adds letters left out of the word, and stems that are complete."""
            todo = list(items.items())
            while todo:
                node, e = todo.pop()
                if items.get(node, 99) < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= reach[child] and items.get(child, 99) > e + 1:
                        items[child] = e + 1
                        todo.append((child, e + 1))
            for node, e in items.items():
                for number, most in ends[node].items():
                    if terms[number][1] and e <= most:
                        done[number] = min(done.get(number, 99), e)
            return frozenset(items.items()), frozenset(done.items())

        start = closed({0: 0}, {})
        number_of = {start: 1, (frozenset(), frozenset()): 0}
        states, table, result = [(frozenset(), frozenset()), start], [], []
        width = len(letters) + 1
        i = 0
        while i < len(states):
            items, done = states[i]
            row = [0] * width
            live = {k for node, _ in items for k in children[node]}
            other = None
            for k in range(width):
                if k not in live and other is not None:
                    row[k] = other
                    continue
                new: dict[int, int] = {}
                for node, e in items:
                    if e + 1 <= reach[node]:  # a letter too many
                        new[node] = min(new.get(node, 99), e + 1)
                    for letter, child in children[node].items():
                        cost = e + (letter != k)
                        if cost <= reach[child]:
                            new[child] = min(new.get(child, 99), cost)
                state = closed(new, dict(done))
                if state not in number_of:
                    number_of[state] = len(states)
                    states.append(state)
                row[k] = number_of[state]
                if k not in live:
                    other = row[k]
            table.append(row)
            best = min(((e, -len(terms[n][0]), n) for node, e in items for n, most in ends[node].items() if e <= most), default=None)
            best = min((x for x in (best, *((e, -len(terms[n][0]), n) for n, e in done)) if x), default=None)
            result.append((best[2], best[0]) if best else (-1, 0))
            i += 1
        self.table = np.array(table, dtype=np.int32)
        self.result = np.array(result, dtype=np.int32)

    def run(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = np.ones(len(starts), dtype=np.int32)
        out = np.zeros(len(starts), dtype=np.int32)
        live, at, stop = np.arange(len(starts)), starts, ends
        while len(live):
            over = at >= stop
            out[live[over]] = state[over]
            go = ~over & (state != 0)
            live, at, stop, state = live[go], at[go], stop[go], state[go]
            state = self.table[state, letters[at]]
            at = at + 1
        return self.result[out, 0], self.result[out, 1]


_letters: dict[str, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if "is" not in _letters:
        _letters["is"] = np.array([chr(i).isalpha() for i in range(0x110000)])
        space = np.zeros(0x110000, dtype=bool)
        space[[i for i in range(0x3001) if chr(i).isspace()]] = True
        quote = np.zeros(0x110000, dtype=bool)
        quote[[ord(c) for c in QUOTES]] = True
        _letters["space"], _letters["quote"] = space, quote
    return _letters["is"]


@dataclass
class Words:
    """Words of some texts: code points, each word's letters, its text's number, and whether quotation marks are at its ends."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    opens: np.ndarray
    closes: np.ndarray

    def text(self, i: int) -> str:
        return self.points[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le")


def words_of(texts: list[str]) -> Words:
    letter = _is_letter()
    joined = "\n".join(texts).lower() if all(len(t.lower()) == len(t) for t in texts) else "\n".join(t.lower() for t in texts)
    limits = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        none = np.empty(0, np.int64)
        return Words(points, none, none, none, none.astype(bool), none.astype(bool))
    inside = ~_letters["space"][points]
    first = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    last = np.flatnonzero(inside & np.concatenate((~inside[1:], [True])))
    alpha = np.flatnonzero(letter[points])
    a, b = np.searchsorted(alpha, first), np.searchsorted(alpha, last, side="right") - 1
    some = a <= b
    first, last, a, b = first[some], last[some], a[some], b[some]
    quote = np.concatenate(([0], np.cumsum(_letters["quote"][points])))
    starts, ends = alpha[a], alpha[b] + 1
    return Words(points, starts, ends, np.searchsorted(limits, starts, side="right") - 1, quote[starts] > quote[first], quote[last + 1] > quote[ends])


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    #: Weight of a term's exact and misspelt matches.
    weights: list[tuple[float, float]] = field(default_factory=list)
    #: Words within reach of a term that the labels show harmless.
    harmless: list[str] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)


_automata: dict[tuple, Automaton] = {}


def automaton(terms: list[tuple[str, bool]]) -> Automaton:
    key = tuple(terms)
    if key not in _automata:
        if len(_automata) > 3:
            _automata.clear()
        _automata[key] = Automaton(terms)
    return _automata[key]


def matches(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places among words, terms and edits of the matches that count."""
    if not model.terms or not len(words.starts):
        return (np.empty(0, np.int64),) * 3
    auto = automaton(model.terms)
    classes = np.zeros(0x110000, dtype=np.uint16)
    for c, k in auto.classes.items():
        classes[ord(c)] = k
    term, edits = auto.run(classes[words.points], words.starts, words.ends)
    at = np.flatnonzero(term >= 0)
    if model.harmless:
        harmless = set(model.harmless)
        at = np.array([i for i in at if edits[i] == 0 or words.text(i) not in harmless], dtype=np.int64)
    return at, term[at], edits[at]


def features(model: Model, texts: list[str]) -> np.ndarray:
    """Of each text: weight of matches outside quotation marks, inside them, with another match in the window, of distinct terms, and the first by the text's length."""
    words = words_of(texts)
    at, term, edits = matches(model, words)
    out = np.zeros((len(texts), 5))
    count = np.bincount(words.doc, minlength=len(texts)) if len(words.doc) else np.zeros(len(texts))
    if len(at):
        weight = np.array(model.weights)[term, np.minimum(edits, 1)]
        doc = words.doc[at]
        opened = np.concatenate(([0], np.cumsum(words.opens)))
        closed = np.concatenate(([0], np.cumsum(words.closes)))
        low, high = np.searchsorted(words.doc, doc), np.searchsorted(words.doc, doc, side="right")
        before, after = np.maximum(low, at - WINDOW), np.minimum(high, at + WINDOW + 1)
        # Quoted: the window before it opens a quotation that it does not close, and the window behind closes one.
        quoted = (opened[at + 1] - opened[before] > closed[at] - closed[before]) & (closed[after] - closed[at] > 0)
        near = np.zeros(len(at), dtype=bool)
        close = (np.diff(at) <= WINDOW) & (doc[1:] == doc[:-1])
        near[1:] |= close
        near[:-1] |= close
        np.add.at(out[:, 0], doc[~quoted], weight[~quoted])
        np.add.at(out[:, 1], doc[quoted], weight[quoted])
        np.add.at(out[:, 2], doc[near], weight[near])
        pair = np.unique(np.stack([doc, term, edits > 0]), axis=1)
        np.add.at(out[:, 3], pair[0], np.array(model.weights)[pair[1], pair[2]])
        out[:, 4] = out[:, 0] / np.log2(4 + count)
    return np.log1p(np.maximum(out, 0))


#: Parts of the sample that a lexicon is learned from: either half, or all.
SUBSETS = (0, 1, None)


def _groups(subset: int | None, value: str = "grp", label: int | None = None) -> Column:
    """Aggregate: distinct values of a subset's rows, and of one label if it is given."""
    inside = F.lit(True) if subset is None else F.col("fold") == subset
    return F.size(F.collect_set(F.when(inside if label is None else inside & (F.col("y") == label), F.col(value))))


def _names(prefix: str) -> list[str]:
    return [f"{prefix}{'_' if s is None else s}" for s in SUBSETS]


def prepared(rows: DataFrame) -> DataFrame:
    """(text, y) with the text's distinct words, its half (fold), and the least hash of its words, which near copies share (grp)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.texts(batch.column("text"))
            for a, b in tb.pieces(offsets):
                texts = batch.column("text")[a:b].to_pylist()
                words = words_of(texts)
                spans = np.searchsorted(words.doc, np.arange(len(texts) + 1))
                own = [sorted({words.text(i) for i in range(spans[d], spans[d + 1])}) for d in range(len(texts))]
                groups = [min((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in x), default=0) for x in own]
                fold = [zlib.crc32(re.sub(r"\s+", " ", t)[:40].encode("utf-8", "surrogatepass")) % 2 for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("text")[a:b], batch.column("y")[a:b], pa.array(fold, pa.int32()), pa.array(groups, pa.int64()), pa.array(own, pa.list_(pa.string()))], names=["text", "y", "fold", "grp", "words"])

    return rows.mapInArrow(kernel, "text string, y int, fold int, grp long, words array<string>")


def parts_of(words: DataFrame) -> DataFrame:
    """Each row once per part of its word: the word itself, and its beginnings of 4 to 8 letters as stems."""
    n = F.length("word")
    whole = F.when(n >= 3, F.array(F.struct(F.col("word").alias("part"), F.lit(False).alias("stem")))).otherwise(F.array())
    stems = F.when(n >= 5, F.transform(F.sequence(F.lit(4), F.least(n, F.lit(9)) - 1), lambda k: F.struct(F.substring("word", F.lit(1), k).alias("part"), F.lit(True).alias("stem")))).otherwise(F.array())
    return words.select("*", F.inline(F.concat(whole, stems)))


def _value(seen: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return float(np.log((seen + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))


def choose_terms(parts: list[tuple[str, bool, int, int, int]], n_toxic: int, n_clean: int) -> dict[tuple[str, bool], float]:
    """Terms and their values, of (part, stem, groups of toxic documents, of clean ones, distinct toxic words): of a stem and its longer stems and words, the one that tells most of most documents."""
    seen = {(p, stem): t for p, stem, t, _, _ in parts if t >= max(3, 0.02 * n_toxic)}
    clean = {(p, stem): c for p, stem, _, c, _ in parts}
    kinds = {p: w for p, stem, _, _, w in parts if stem}
    value = {p: _value(seen[p], clean[p], n_toxic, n_clean) for p in seen}
    telling = sorted((p for p in seen if value[p] >= 2.5 and seen[p] >= 4 * clean[p]), key=lambda p: (-seen[p] * value[p], len(p[0]), p))
    covered: set[str] = set()
    terms: list[tuple[str, bool]] = []
    for text, stem in telling:
        if any(text[:k] in covered for k in range(4, len(text) + 1)):
            continue
        if stem and kinds[text] < 4:
            continue
        if stem and any(w.startswith(text) and seen[w, False] >= 0.8 * seen[text, True] for w, s in terms if not s and len(w) > len(text)):
            continue  # one word makes up the stem
        if stem:
            covered.add(text)
        terms.append((text, stem))
        if len(terms) >= TERMS:
            break
    return {t: value[t] for t in terms if t[1] or not any(t[0][:k] in covered for k in range(4, len(t[0]) + 1))}


def misspelt(words: DataFrame, models: list[Model]) -> DataFrame:
    """Of distinct words, those that a model's automaton takes for a misspelt term: the words' columns, the model's number and the term's."""
    names = words.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = words_of(batch.column("word").to_pylist())
            for number, model in enumerate(models):
                at, term, edits = matches(Model(terms=model.terms), own)
                at, term = at[edits > 0], term[edits > 0]
                found = batch.take(pa.array(own.doc[at], pa.int64()))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.full(len(at), number), pa.int32()), pa.array(term, pa.int32())], names=[*names, "model", "term"])

    return words.mapInArrow(kernel, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", model int, term int")


def learn_lexicons(sample: DataFrame) -> list[Model]:
    """Of the prepared sample, the model of each of SUBSETS, without coefficients. Parts and words are counted in Spark, documents of one group once; only what a share of the toxic ones has comes to the driver, which for texts of bounded length is a bounded number."""
    sizes = sample.groupBy("y").agg(*[_groups(s).alias(n) for s, n in zip(SUBSETS, _names("n"), strict=True)]).collect()
    totals = [[max([1, *(r[n] for r in sizes if r["y"] == y)]) for y in (1, 0)] for n in _names("n")]
    words = sample.select("y", "fold", "grp", F.explode("words").alias("word"))
    toxic = parts_of(words.where("y = 1")).groupBy("part", "stem").agg(*[_groups(s).alias(n) for s, n in zip(SUBSETS, _names("t"), strict=True)], *[_groups(s, "word").alias(n) for s, n in zip(SUBSETS, _names("w"), strict=True)])
    often = [F.col(n) >= max(3, 0.02 * total[0]) for n, total in zip(_names("t"), totals, strict=True)]
    toxic = written(toxic.where(often[0] | often[1] | often[2]), "parts")
    clean = parts_of(words.where("y = 0")).join(toxic.select("part", "stem"), ["part", "stem"]).groupBy("part", "stem").agg(*[_groups(s).alias(n) for s, n in zip(SUBSETS, _names("c"), strict=True)])
    counts = toxic.join(clean, ["part", "stem"], "left").fillna(0).collect()
    valued = [choose_terms([(r["part"], r["stem"], r[t], r[c], r[w]) for r in counts], *total) for t, c, w, total in zip(_names("t"), _names("c"), _names("w"), totals, strict=True)]
    models = [Model(terms=list(v)) for v in valued]
    each = words.groupBy("word").agg(*[_groups(s, label=y).alias(n) for y, p in ((1, "t"), (0, "c")) for s, n in zip(SUBSETS, _names(p), strict=True)])
    found = misspelt(each, models).collect()
    for number, (model, value, (n_toxic, n_clean)) in enumerate(zip(models, valued, totals, strict=True)):
        own = [(r["word"], r["term"], r[_names("t")[number]], r[_names("c")[number]]) for r in found if r["model"] == number]
        model.harmless = sorted(w for w, _, t, c in own if c and t * n_clean < 4 * c * n_toxic)
        # What a misspelling not seen before is worth: among words seen in one document only, those of toxic documents.
        for k, term in enumerate(model.terms):
            single = [t for _, of, t, c in own if of == k and t + c == 1]
            t, c = sum(single), len(single) - sum(single)
            worth = float(np.log((t + 0.5) / n_toxic) - np.log((c + 0.05) / n_clean)) if c else value[term]
            model.weights.append((max(0.0, value[term]), float(np.clip(worth, 0.0, value[term]))))
    return models


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Intercept and coefficients by Newton steps with a ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge * len(x) / 100 + 0.1] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def fold_features(sample: DataFrame, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample's rows, each row's by the lexicon of the other half, in an order of their own."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.texts(batch.column("text"))
            for a, b in tb.pieces(offsets):
                texts, fold = batch.column("text")[a:b].to_pylist(), batch.column("fold")[a:b].to_numpy()
                x = np.zeros((len(texts), 5))
                for f in (0, 1):
                    own = np.flatnonzero(fold == f)
                    x[own] = features(models[1 - f], [texts[i] for i in own])
                yield pa.RecordBatch.from_arrays([batch.column("y")[a:b], pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    rows = sorted((r["y"], *r["x"]) for r in sample.select("text", "fold", "y").mapInArrow(kernel, "y int, x array<double>").collect())
    return np.array([r[1:] for r in rows]), np.array([r[0] for r in rows], dtype=np.float64)


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, sample: int) -> Model:
    """Model from `sample` labelled documents at most, those of least hash of their id, with one text (the least) for each id. Their texts stay with the executors; features for the logistic part come from lexicons learned on the other half. Labels of one class, or none, give that class's share as score."""
    known = labels.select(F.col(id_col).alias("known"), F.col(label_col).cast("int").alias("y")).where(F.col("known").isNotNull() & F.col("y").isNotNull())
    known = known.withColumnRenamed("known", id_col).where(usable).groupBy(id_col).agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample).withColumnRenamed(id_col, "known")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("known"))
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).groupBy("text").agg(F.max("y").alias("y"))
    own = written(prepared(rows.select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y")).repartition(TASKS)), "sample")
    share = own.agg(F.avg("y")).first()[0]
    if share in (None, 0.0, 1.0):
        share = 0.5 - 1e-9 if share is None else float(np.clip(share, 0.001, 0.999))
        return Model(coefficients=[float(np.log(share / (1 - share))), *[0.0] * 5])
    models = learn_lexicons(own)
    x, y = fold_features(own, models)
    models[2].coefficients = fit_logistic(x, y)
    return models[2]


def score(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, score, n_matches) of each row of docs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = np.array(model.coefficients)
        for batch in batches:
            _, offsets = tb.texts(batch.column("text"))
            for a, b in tb.pieces(offsets):
                texts = batch.column("text")[a:b].to_pylist()
                x = features(model, texts)
                p = 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], pa.array(p, pa.float64()), pa.array(x[:, 0] + x[:, 1] > 0, pa.bool_())], names=["id", "score", "matched"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(kernel, "id long, score double, matched boolean").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: id, score (0 to 1), matched, predicted (score >= 0.5).

    usable, of the id column, says which labels may be learned from. Of several labels of an id the largest counts; null
    ids or labels are not learned from. Null texts are empty; a text without matches has the score that the labels give
    such texts. Rows with equal ids are scored alone. Languages, sources and ids are no inputs of a score.
    """
    model = train(docs, labels, usable, id_col, text_col, label_col, sample)
    return score(docs, model, id_col, text_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxic_removed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """docs, with its columns and repeated rows, less the documents predicted toxic by a model learned from the labels of docs. Each text is judged in place, so nothing is shuffled."""
    model = train(docs, labels, F.lit(True), id_col, text_col, label_col, sample)

    @F.arrow_udf("boolean")
    def toxic(text: pa.Array) -> pa.Array:
        beta = np.array(model.coefficients)
        out = [np.empty(0, bool)]
        _, offsets = tb.texts(text)
        for a, b in tb.pieces(offsets):
            out.append(beta[0] + features(model, ["" if t is None else t for t in text[a:b].to_pylist()]) @ beta[1:] >= 0)
        return pa.array(np.concatenate(out))

    return docs.where(~toxic(F.col(text_col)))
