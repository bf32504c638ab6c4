"""Toxicity scores: a lexicon trie met with Levenshtein automata, and words in context.

The lexicon is learned: words and word stems that are used more in toxic training documents
than in others, weighted by the logarithm of that ratio, beside a few fixed insults. Its trie is intersected with the Levenshtein automaton of distance one
(first letter fixed; words of ``FUZZY`` letters or more) by subset construction, which
gives one table-driven automaton that accepts every listed word, its misspellings with one
edit, and every word beginning with a stem. It runs over all words of a block of texts at
once, letter by letter; most words leave it after two or three.

Every hit is then read in its window of words: a hit between quotation marks or beside words
of reporting counts as quoted, one beside words of address as directed. Summed weights by
kind and per word go into a logistic regression, which weighs quotation against abuse.

Only labels of rows whose crc32(doc_id) modulo 4 is not 2 are learned from, and of these a
sample of at most ``FIT_ROWS`` rows, lowest hash of the id first; the sample bounds what is
broadcast and what reaches the driver. Everything else runs over all documents.

Edge cases: NULL and empty texts are scored by the model's value for no words; NULL labels and
labels of unknown documents teach nothing; a document labelled both ways counts as toxic;
without labels of both kinds fixed weights over the fixed insults are used; a NULL id is
not held out; repeated rows get equal scores; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, kept, map_arrow, stored, table

FIT_ROWS = 20_000
TERMS = 128
RATIO = 4.0
FOLDS = 3
USES = 4  # of a term that one training document counts with
THRESHOLD = 0.3
FUZZY = 5
WINDOW = 4
STEMS = range(3, 9)
BLOCK_CHARS = 1 << 17

# Plain insults, words of reporting and words of address.
INSULTS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid",
           "trash", "worthless"]
REPORTING = {"said", "says", "wrote", "quote", "quoted", "quoting", "called", "word", "term",
             "phrase", "slur", "dit", "sagte", "dijo", "wort", "mot", "palabra"}
ADDRESS = {"you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "te", "toi", "vous",
           "eres", "usted"}
QUOTES = "\"“”«»„‟‘’`"


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    letters = np.array([chr(i).isalnum() for i in range(1 << 16)])
    inner = np.zeros(1 << 16, bool)
    inner[[ord(c) for c in "@$*!+|"]] = True
    return letters, inner


LETTER, INNER = _character_tables()


@dataclass
class Automaton:
    """Table of the intersected automaton; state 0 starts, state 1 rejects for good."""

    classes: np.ndarray  # class of each 16-bit character
    step: np.ndarray     # next state by state and class
    exact: np.ndarray    # by state: weight of the listed word that ends here, or 0
    near: np.ndarray     # by state: weight of the listed word one edit away, or 0
    stem: np.ndarray     # by state: weight of the stem the word begins with, or 0


def build_automaton(words: dict[str, float], stems: dict[str, float]) -> Automaton:
    children, ends, stem_ends, fuzzy = [{}], [0.0], [0.0], [False]
    for text, weight, is_stem in [(w, x, False) for w, x in words.items()] + [
            (t, x, True) for t, x in stems.items()]:
        at, path = 0, [0]
        for c in text:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(0.0)
                stem_ends.append(0.0)
                fuzzy.append(False)
            at = children[at][c]
            path.append(at)
        (stem_ends if is_stem else ends)[at] = weight
        if not is_stem and len(text) >= FUZZY:
            for node in path:
                fuzzy[node] = True
    letters = sorted({c for node in children for c in node if ord(c) < 1 << 16})
    classes = np.zeros(1 << 16, np.uint8 if len(letters) < 255 else np.uint16)
    for i, c in enumerate(letters):
        classes[ord(c)] = i + 1

    def follow(states, c):
        reached = set()
        for node, edits in states:
            if c in children[node]:
                child = children[node][c]
                if not edits or fuzzy[child]:
                    reached.add((child, edits))
            if edits or not node or not fuzzy[node]:
                continue
            reached.add((node, 1))  # c was inserted
            for x, child in children[node].items():
                if not fuzzy[child]:
                    continue
                if x != c:
                    reached.add((child, 1))  # c stands for x
                if c in children[child] and fuzzy[children[child][c]]:
                    reached.add((children[child][c], 1))  # x was left out
        return frozenset(reached)

    ids = {frozenset([(0, 0)]): 0, frozenset(): 1}
    order, table_rows = [frozenset([(0, 0)]), frozenset()], []
    at = 0
    while at < len(order):
        row = []
        for c in ["\0", *letters]:
            target = follow(order[at], c)
            if target not in ids:
                ids[target] = len(order)
                order.append(target)
            row.append(ids[target])
        table_rows.append(row)
        at += 1
    exact, near, stem = (np.zeros(len(order)) for _ in range(3))
    for i, states in enumerate(order):
        for node, edits in states:
            if edits:
                near[i] = max(near[i], ends[node] if fuzzy[node] else 0)
                continue
            stem[i] = max(stem[i], stem_ends[node])
            exact[i] = max(exact[i], ends[node])
            for x in children[node].values() if fuzzy[node] else ():
                near[i] = max(near[i], ends[x] if fuzzy[x] else 0)
    near[exact > 0] = 0
    return Automaton(classes, np.array(table_rows, np.int32), exact, near, stem)


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: letters and digits, and symbols between two of them."""
    inside = LETTER[codes]
    joined = INNER[codes]
    if joined.any():
        joined[0] = joined[-1] = False
        joined[1:-1] &= inside[:-2] & inside[2:]
        inside = inside | joined
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lexicon_hits(auto: Automaton, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(index, weight) of matching words: those exact or by stem, and those by one edit."""
    kind = auto.classes[codes]
    live = np.arange(len(starts))
    state = np.zeros(len(starts), np.int32)
    at = starts.copy()
    exact, near = np.zeros(len(starts)), np.zeros(len(starts))
    while len(live):
        state = auto.step[state, kind[at]]
        at = at + 1
        by_stem = auto.stem[state] > 0
        done = at == ends[live]
        exact[live[by_stem]] = auto.stem[state[by_stem]]
        finished = done & ~by_stem
        exact[live[finished]] = auto.exact[state[finished]]
        near[live[finished]] = auto.near[state[finished]]
        go = ~done & ~by_stem & (state != 1)
        live, state, at = live[go], state[go], at[go]
    found = np.flatnonzero(exact), np.flatnonzero(near)
    return [(i, w[i]) for i, w in zip(found, (exact, near), strict=True)]


def blocks_of(column: pa.Array):
    """(first row, lower-cased texts) of about ``BLOCK_CHARS`` characters."""
    texts, size, first = [], 0, 0
    for i, value in enumerate(column):
        texts.append((value.as_py() or "").lower())
        size += len(texts[-1])
        if size >= BLOCK_CHARS:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


FEATURES = 9


def features(column: pa.Array, auto: Automaton) -> np.ndarray:
    """One row of features per text."""
    result = np.zeros((len(column), FEATURES))
    for first, texts in blocks_of(column):
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(codes, 0xFFFF)
        if not len(codes):
            continue
        starts, ends = word_spans(codes)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        words_before = np.searchsorted(starts, bounds)
        count = np.diff(words_before)
        tally = np.zeros((len(texts), 4))
        hits = np.zeros(len(texts))
        for kind, (found, weight) in enumerate(lexicon_hits(auto, codes, starts, ends)):
            owner = np.searchsorted(bounds, starts[found], "right") - 1
            np.add.at(tally[:, kind], owner, weight)
            np.add.at(hits, owner, 1)
            for word, doc, worth in zip(found.tolist(), owner.tolist(), weight.tolist(),
                                        strict=True):
                low = max(word - WINDOW, words_before[doc])
                high = min(word + WINDOW + 1, words_before[doc + 1])
                around = {joined[starts[w]:ends[w]] for w in range(low, high) if w != word}
                left = joined[max(starts[low] - 1, bounds[doc]):starts[word]]
                right = joined[ends[word]:min(ends[high - 1] + 1, bounds[doc + 1])]
                quoted = (any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
                          or bool(around & REPORTING))
                tally[doc, 2] += worth * quoted
                tally[doc, 3] += worth * (bool(around & ADDRESS) and not quoted)
        plain = np.maximum(tally[:, 0] + tally[:, 1] / 2 - tally[:, 2], 0)
        per_word = plain / np.maximum(count, 1)
        rows = slice(first, first + len(texts))
        result[rows, 0] = np.log1p(tally[:, 0])
        result[rows, 1] = np.log1p(tally[:, 1])
        result[rows, 2] = np.log1p(tally[:, 2])
        result[rows, 3] = np.log1p(tally[:, 3])
        result[rows, 4] = np.log1p(plain)
        result[rows, 5] = np.sqrt(per_word)
        result[rows, 6] = np.log1p(100 * per_word)
        result[rows, 7] = np.minimum(hits, 3) / 3
        result[rows, 8] = np.log1p(count) / 10
    return result


# Weights without labels of both kinds: a listed word outweighs the rest.
PLAIN_WEIGHTS = np.array([-4.0, 1.5, 0.7, -1.0, 0.5, 1.0, 2.0, 0.5, 1.0, 0.0])
PLAIN_TERM = 4.0


def fit_weights(rows: np.ndarray, labels: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept comes first."""
    x = np.column_stack([np.ones(len(rows)), rows])
    weights = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * weights
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        change = np.linalg.solve(hessian, gradient)
        weights -= change
        if np.abs(change).max() < 1e-8:
            break
    return weights


def terms_of(text: str) -> Counter:
    """Uses of whole words (closed by a dot) and of stems in a text."""
    found = Counter()
    for w, n in Counter(re.findall(r"[^\W\d_]+", text.lower())).items():
        if len(w) > 2:
            found[w + "."] += n
        for k in STEMS:
            if len(w) <= k:
                break
            found[w[:k]] += n
    return found


def fold_of(text: str) -> int:
    """Fold of a training text by its beginning, so that near copies share one."""
    return zlib.crc32(text[:64].encode("utf-8", "surrogatepass")) % FOLDS


def choose_terms(counted: dict[str, tuple[int, int]], toxic_size: int, clean_size: int,
                 limit: int) -> dict[str, float]:
    """Terms that tell most, with the logarithm of their ratio of use, longest of equal ones.

    A term beside its own prefix or extension adds nothing and is left out.
    """
    rated = []
    for term, (toxic, clean) in counted.items():
        ratio = (toxic / toxic_size) / ((clean + 0.5) / clean_size)
        if ratio >= RATIO:
            rated.append((-toxic * np.log(ratio), -len(term), term, float(np.log(ratio))))
    chosen: dict[str, float] = {}
    for _, _, term, weight in sorted(rated):
        bare = term.rstrip(".")
        if not any(bare.startswith(c.rstrip(".")) or c.startswith(bare) for c in chosen):
            chosen[term] = weight
            if len(chosen) == limit:
                break
    return chosen


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled documents that may be learned from."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic"))
              .where("doc_id is not null and toxic in (0, 1)")
              .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sample = kept(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    # Bounded by ``fit_rows``.
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")
    return stored(rows.where("text is not null").dropDuplicates(["text", "toxic"]), "toxic")


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS,
          terms: int = TERMS) -> Model:
    rows = training_rows(docs, labels, fit_rows)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(dict.fromkeys(INSULTS, PLAIN_TERM), {}, PLAIN_WEIGHTS)

    def count(batch):
        uses, held = Counter(), Counter()
        for text, label in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
            text = text.as_py()
            part = (label, fold_of(text))
            found = terms_of(text)
            uses.update({(*part, t): min(n, USES) for t, n in found.items()
                         if marks is None or t in marks})
            held.update((*part, t) for t in found if marks is None)
            uses[(*part, "")] += text.count(" ") + 1
        yield {"toxic": [k[0] for k in uses], "fold": [k[1] for k in uses],
               "term": [k[2] for k in uses], "n": list(uses.values()),
               "docs": [held[k] for k in uses]}

    def totals(label):
        counted = map_arrow(rows.where(F.col("toxic") == label), count,
                            "toxic int, fold int, term string, n long, docs long")
        return counted.groupBy("fold", "term").agg(F.sum("n").alias("n"),
                                                   F.sum("docs").alias("docs"))

    marks = None
    support = max(4, toxic * 3 // 100)
    enough = Window.partitionBy("term")
    # Bounded by the sample; the empty term carries the number of words.
    used = (totals(1).withColumn("all", F.sum("docs").over(enough))
            .where((F.col("all") >= support) | (F.col("term") == ""))
            .orderBy(F.desc("all"), "term").limit(800 * terms).collect())
    marks = {r["term"] for r in used} - {""}
    others = totals(0).collect()

    def lexicon(folds) -> tuple[dict[str, float], dict[str, float]]:
        toxic_uses, clean_uses = Counter(), Counter()
        for into, source in ((toxic_uses, used), (clean_uses, others)):
            for r in source:
                if r["fold"] in folds:
                    into[r["term"]] += r["n"]
        sizes = toxic_uses.pop("", 0) + 1, clean_uses.pop("", 0) + 1
        chosen = choose_terms({t: (n, clean_uses[t]) for t, n in toxic_uses.items()}, *sizes,
                              terms)
        return (dict.fromkeys(INSULTS, PLAIN_TERM) | {
            t[:-1]: w for t, w in chosen.items() if t.endswith(".")},
            {t: w for t, w in chosen.items() if not t.endswith(".")})

    # Every training text is measured by the terms of the other folds, so that weights do
    # not trust terms which only this sample's own documents suggest.
    lexicons = [lexicon(set(range(FOLDS)) - {fold}) for fold in range(FOLDS)]

    def measure(batch):
        automata = [build_automaton(*x) for x in lexicons]
        fold = np.array([fold_of(t.as_py()) for t in batch["text"]])
        values = np.zeros((batch.num_rows, FEATURES))
        for f, auto in enumerate(automata):
            own = np.flatnonzero(fold == f)
            values[own] = features(batch["text"].take(pa.array(own)), auto)
        yield {"toxic": batch["toxic"], "x": list(values)}

    fitted = map_arrow(rows, measure, "toxic int, x array<double>").toPandas()
    x = np.array(fitted["x"].tolist())
    return Model(*lexicon(set(range(FOLDS))), fit_weights(x, fitted["toxic"].to_numpy()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id, k_id and k_tx if there, and the score."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        auto = build_automaton(model.words, model.stems)
        for batch in batches:
            logit = model.weights[0] + features(batch["text"], auto) @ model.weights[1:]
            value = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.record_batch([*(batch[n] for n in names), pa.array(value)],
                                  names=[*names, "score"])

    schema = ", ".join(f"{n} long" for n in names) + ", score double"
    return docs.select(*names, "text").mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    model = learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
