"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with hits weighed in their context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.minhash import band_buckets, one_permutation
from taskfold.llm.tables import dropped, stored, table, whole_rows, with_row

_PLAIN = re.compile(r"[^\W_]+")
#: Words may be disguised by symbols between or before their letters.
_WORD = re.compile(r"[@$]?[^\W_]+(?:[!@$*_|]+[^\W_]+)*")
#: Symbols and figures that stand for letters (fixed list); other symbols inside a word are left out.
_ALIKE = str.maketrans("!|1@4$503€7", "iiiaassoeet", "*_")
#: Labelled rows that the model is fitted on, at most; their classes are mixed as those of all labelled rows.
SAMPLE_ROWS = 24_000
MAX_TERMS = 2_000
LEAST_STEM = 4
#: Words of a context window, to either side of a hit.
REACH = 10
#: Words that announce a quotation (fixed list).
REPORTING = frozenset(
    "said says wrote writes called calls quote quoted quotes quoting word words term termed "
    "sagte schrieb nannte zitat wort dit écrit appelé mot cite dijo escribió llamó palabra cita".split()
)
_OPEN, _CLOSE, _EITHER = "“«„‹", "”»“›", '"'
_DEAD = -1


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # matches the start of a longer word, else the whole word

    @property
    def edits(self) -> int:
        """Letters that may differ."""
        n = len(self.text)
        return (0 if n < 6 else 1) if self.stem else (0 if n < 4 else 1 if n < 8 else 2)


class Matcher:
    """The Levenshtein automata of all terms, walked together over their trie.

    A state is a set of (trie node, letters that differ so far). States and their successors are kept as they
    are met, so a word costs one dictionary step per letter and ends at the first letter that leaves no term.
    """

    def __init__(self, terms: list[Term], exceptions: frozenset[str] = frozenset(), max_states: int = 50_000):
        self.terms, self.exceptions, self.max_states = terms, exceptions, max_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.limit = [0]  # most edits that a term below allows
        for i, term in enumerate(terms):
            node = 0
            self.limit[0] = max(self.limit[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.limit.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], term.edits)
            self.ends[node].append(i)
        self._restart()

    def _restart(self) -> None:
        start: dict[int, int] = {}
        self._reach(start, 0, 0)
        self.states: list[tuple[frozenset, tuple | None]] = [(frozenset(start.items()), None)]
        self.ids = {self.states[0]: 0}
        self.next: list[dict[str, int]] = [{}]
        self.seen: dict[str, tuple[int, int] | None] = {}

    def _reach(self, reached: dict[int, int], node: int, edits: int) -> None:
        if edits <= self.limit[node] and edits < reached.get(node, 99):
            reached[node] = edits
            for child in self.children[node].values():  # a letter of the term is missing in the word
                self._reach(reached, child, edits + 1)

    def _step(self, state: int, letter: str) -> int:
        nodes, best = self.states[state]
        for node, edits in nodes:  # another letter follows, so starts that end here match
            for i in self.ends[node]:
                if self.terms[i].stem and edits <= self.terms[i].edits:
                    best = min(best or (99, 0), (edits, i))
        reached: dict[int, int] = {}
        for node, edits in nodes:
            if letter in self.children[node]:
                self._reach(reached, self.children[node][letter], edits)
            self._reach(reached, node, edits + 1)
            for child in self.children[node].values():
                self._reach(reached, child, edits + 1)
        if not reached and best is None:
            target = _DEAD
        else:
            new = (frozenset(reached.items()), best)
            target = self.ids.setdefault(new, len(self.states))
            if target == len(self.states):
                self.states.append(new)
                self.next.append({})
        self.next[state][letter] = target
        return target

    def find(self, word: str) -> tuple[int, int] | None:
        """(letters that differ, term) of the closest term, or None."""
        found = self.seen.get(word, _DEAD)
        if found != _DEAD:
            return found
        if len(self.states) > self.max_states:
            self._restart()
        if len(self.seen) > 200_000:
            self.seen.clear()
        state = 0
        for letter in word:
            after = self.next[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if state == _DEAD:
                break
        found = None
        if state != _DEAD and word not in self.exceptions:
            nodes, found = self.states[state]
            for node, edits in nodes:
                for i in self.ends[node]:
                    if not self.terms[i].stem and edits <= self.terms[i].edits:
                        found = min(found or (99, 0), (edits, i))
        self.seen[word] = found
        return found

    def find_disguised(self, word: str) -> tuple[int, int] | None:
        """The closest term to the word, to its parts between symbols, or to what its symbols and figures look like."""
        if word.isalpha():
            return self.find(word)
        forms = {word.translate(_ALIKE), *_PLAIN.findall(word)}
        return min((f for w in forms if (f := self.find(w)) is not None), default=None)

    def hits(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(word number, letters that differ, term, quoted) of all hits, in order."""
        lower = text.lower()
        find = self.find_disguised
        known = {w: f for w in set(_WORD.findall(lower)) if (f := find(w)) is not None}
        if not known:
            return []
        words = list(_WORD.finditer(lower))
        out = []
        for n, m in enumerate(words):
            if m[0] in known:
                edits, term = known[m[0]]
                out.append((n, edits, term, quoted(lower, words, n)))
        return out


def quoted(text: str, words: list[re.Match], n: int) -> bool:
    """Whether the n-th word stands between quotation marks in its context window, or follows a reporting word."""
    m = words[n]
    before = text[words[n - REACH - 1].end() if n > REACH else 0 : m.start()]
    after = text[m.end() : words[n + REACH + 1].start() if n + REACH + 1 < len(words) else len(text)]
    if before.count(_EITHER) % 2 and _EITHER in after:
        return True
    opened = max(before.rfind(c) for c in _OPEN)
    if opened >= 0 and not any(c in before[opened + 1 :] for c in _CLOSE) and any(c in after for c in _CLOSE):
        return True
    return any(w[0] in REPORTING for w in words[max(0, n - 4) : n])


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    exceptions: frozenset[str]
    weights: dict[tuple[int, int, bool], float]  # chance of label 1 by (term, edits, quoted)
    without: float  # chance of label 1 with no hit

    def score(self, hits: list[tuple[int, int, int, bool]]) -> float:
        """The highest of 1 - product of (1 - weight) over the hits of a context window; windows start at hits."""
        best, high = self.without, 0
        for low in range(len(hits)):
            high = max(high, low)
            while high < len(hits) and hits[high][0] - hits[low][0] <= 2 * REACH:
                high += 1
            miss = 1.0
            for h in hits[low : min(high, low + 50)]:  # beyond fifty factors the product is at its limit
                miss *= 1 - self.weights[h[2], h[1], h[3]]
            best = max(best, 1 - miss)
        return best


def labelled_sample(docs: DataFrame, labels: DataFrame, n_rows: int) -> DataFrame:
    """text, toxic of at most ``n_rows`` training documents, picked by a hash of the id and nothing else: the share of
    toxic ones is that of all labelled rows, however many there are.

    The picked ids have a bound, so they are sent to the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(
        "doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 5 <> 0"
    )
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(picked), "doc_id"
    ).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


#: Bins of the sketch by which sampled texts are grouped; a group's texts agree with another of it in half of them.
SKETCH_BINS = 64


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, MinHash sketch of the pairs of words) of each text that has words."""
    for batch in batches:
        for first, end, data, offsets in bt.slices(batch.column(0)):
            hashes, owner, _, _ = bt.hashed_words(data, offsets, bt.BY_SPACE)
            pairs, of = bt.distinct(*bt.shingles(hashes, owner, end - first, 2))
            sketch = one_permutation(pairs, of, end - first, SKETCH_BINS)
            texts = batch.column(0)[first:end].to_pylist()
            some = np.unique(of).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(texts[i]) for i in some], pa.int64()), pa.array([sketch[i].tobytes() for i in some], pa.binary())],
                ["digest", "sketch"],
            )


def copies(sample: DataFrame) -> dict[int, int]:
    """digest -> group of the sampled texts that are near-equal to others; all others are groups of their own.

    The sample has a bound, so its sketches go through the driver. Texts that share a band of two bins are held
    against the first of that bucket only.
    """
    rows = sample.mapInArrow(_sketches, "digest long, sketch binary").distinct().orderBy("digest").collect()
    if not rows:
        return {}
    digests = [r["digest"] for r in rows]
    sketches = np.stack([np.frombuffer(r["sketch"], np.uint64) for r in rows])
    group = list(range(len(rows)))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for buckets in band_buckets(sketches, 2).T:
        _, first, back = np.unique(buckets, return_index=True, return_inverse=True)
        alike = (sketches == sketches[first[back]]).sum(axis=1) * 2 >= SKETCH_BINS
        for i in np.flatnonzero(alike & (first[back] != np.arange(len(rows)))).tolist():
            x, y = top(i), top(int(first[back[i]]))
            group[max(x, y)] = min(x, y)
    return {d: digests[top(i)] for i, d in enumerate(digests) if top(i) != i}


def _word_contexts(groups: dict[int, int]):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct (word, word before, toxic, group), where a word first stands in a document."""
        seen: set = set()

        def flush() -> pa.RecordBatch:
            rows = list(seen)
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))],
                ["word", "before", "toxic", "of"],
            )

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _digest(text)
                of = groups.get(own, own)
                words = _PLAIN.findall(text.lower())
                before = ["", *words[:-1]]
                seen.update((w, b, toxic, of) for w, b in dict(zip(reversed(words), reversed(before))).items())
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    return contexts


def lexicon(
    sample: DataFrame,
    max_terms: int = MAX_TERMS,
    max_exceptions: int = 20_000,
    least: int = 8,
    least_share: float = 0.9,
    groups: dict[int, int] | None = None,
) -> tuple[list[Term], frozenset[str]]:
    """Words, and starts that many words share, that tell toxic documents from clean ones.

    Counted are the different words before a word where it first stands in a document, in toxic and in clean ones,
    and no more of them than ``groups`` of near-equal documents (see ``copies``) have the word: however long a toxic
    document is or however often it was copied or varied, its own rare words gain no weight by it. A term needs
    ``least`` of them, whatever the size of the sample.
    A start counts if at least five longer words have it, nine tenths of which are met more among toxic documents.
    Of a start and its continuations the shortest that is as telling is kept. Words that a term would match, but
    that clean documents use as much, are the exceptions.
    """
    groups = copies(sample) if groups is None else groups
    contexts = sample.mapInArrow(_word_contexts(groups), "word string, before string, toxic int, of long")
    support = contexts.groupBy("word", "toxic").agg(F.least(F.countDistinct("before"), F.countDistinct("of")).alias("n"))
    words = support.groupBy("word").agg(
        *[F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("n"))), F.lit(0)).alias(name) for t, name in enumerate(("clean", "toxic"))]
    )
    words = stored(words, "words")
    heads = F.explode(F.expr(f"transform(sequence({LEAST_STEM}, least(12, length(word) - 1)), n -> substring(word, 1, n))"))
    longer = words.filter(f"length(word) > {LEAST_STEM}").select("*", heads.alias("start"))
    telling = (
        (F.col("toxic") >= least)
        & (F.length("word") > 2)
        & ((F.col("toxic") - 1) / (F.col("toxic") + F.col("clean")) >= least_share)
    )
    starts = (
        longer.groupBy(F.col("start").alias("word"))
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count_if(F.col("toxic") > F.col("clean")).alias("bad"), F.count("*").alias("words"))
        .filter((F.col("bad") >= 5) & (F.col("bad") >= least_share * F.col("words")) & telling)
    )
    # the words of a start may all be of a few groups
    own = longer.select("start", "word").join(starts.select(F.col("word").alias("start")), "start")
    held = contexts.join(own, "word").groupBy(F.col("start").alias("word"), "toxic").agg(F.countDistinct("of").alias("n"))
    held = held.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("n"))), F.lit(0)).alias(f"of{t}") for t in (0, 1)])
    starts = starts.join(held, "word").select("word", F.least("clean", "of0").alias("clean"), F.least("toxic", "of1").alias("toxic"))
    both = words.selectExpr("word", "clean", "toxic", "false AS stem").union(starts.selectExpr("word", "clean", "toxic", "true AS stem"))
    telling = both.filter(telling)
    found = telling.orderBy(F.col("toxic").desc(), "word", "stem").limit(max_terms).collect()
    stems = {r["word"] for r in found if r["stem"]}
    covered = lambda word: any(word[:n] in stems for n in range(LEAST_STEM, len(word)))
    terms = [Term(r["word"], r["stem"]) for r in found if not covered(r["word"])]

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            yield batch.filter(pa.array([matcher.find(w) is not None for w in batch.column(0).to_pylist()], pa.bool_()))

    usual = words.filter("clean >= toxic").select("word", "clean").mapInArrow(matched, "word string, clean long")
    usual = usual.orderBy(F.col("clean").desc(), "word").limit(max_exceptions).collect()
    dropped(words)
    return terms, frozenset(r["word"] for r in usual)


def fitted(docs: DataFrame, labels: DataFrame, n_rows: int = SAMPLE_ROWS) -> Model:
    """The lexicon, and the weight of each (term, letters that differ, quoted): the share of toxic documents among those
    of the sample with such a hit, drawn towards a prior by four pseudo-documents. Near-equal documents with the same
    label count once.

    The prior of misspellings is learned as well: it is the share that all misspellings with so many edits have,
    apart for terms whose misspellings no clean document holds and for the others, which are close to ordinary words.
    Repeated labels of a document count once, as toxic if one says so; documents are not told apart by a null doc_id.
    """
    sample = stored(labelled_sample(docs, labels, n_rows), "sample")
    groups = copies(sample)
    terms, exceptions = lexicon(sample, groups=groups)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, exceptions)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _digest(text)
                found = {(t, e, q) for _, e, t, q in matcher.hits(text)} or {(-1, 0, False)}
                rows += [(*f, toxic, groups.get(own, own)) for f in found]
            types = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["term", "edits", "quoted", "toxic", "of"]
            )

    counted = sample.mapInArrow(kinds, "term int, edits int, quoted boolean, toxic int, of long").distinct()
    rows = counted.groupBy("term", "edits", "quoted").agg(
        F.sum("toxic").alias("toxic"), F.count("*").alias("all")
    ).collect()  # at most six rows a term
    dropped(sample)
    seen = {(r["term"], r["edits"], r["quoted"]): (r["toxic"], r["all"]) for r in rows}
    ordinary = {t for (t, e, _), (toxic, all_) in seen.items() if e and all_ > toxic}
    pooled: dict[tuple[bool, int], list[int]] = {}
    for (t, e, q), (toxic, all_) in seen.items():
        if e and not q:
            own = pooled.setdefault((t in ordinary, e), [0, 0])
            own[0], own[1] = own[0] + toxic, own[1] + all_
    weights = {}
    for i, term in enumerate(terms):
        for edits in range(term.edits + 1):
            toxic, all_ = pooled.get((i in ordinary, edits), (0, 0))
            misspelt = (toxic + (0.5 if i in ordinary else 0.75)) / (all_ + 1)
            for q in (False, True):
                toxic, all_ = seen.get((i, edits, q), (0, 0))
                prior = 0.35 if q else misspelt if edits else 0.9
                weights[i, edits, q] = min(0.995, (toxic + 4 * min(prior, 0.9)) / (all_ + 4))
    toxic, all_ = seen.get((-1, 0, False), (0, 0))
    return Model(tuple(terms), exceptions, weights, min(0.45, (toxic + 0.02) / (all_ + 1)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns), score, predicted, n_hits.

    The whole text is read. Null and empty texts have no hit and get the chance of label 1 without a hit. Only
    the text is used. Rows are scored one by one, so repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        matcher = Matcher(list(own.terms), own.exceptions)
        for batch in batches:
            found = [matcher.hits(t.as_py() or "") for t in batch.column(0).field("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.score(h) for h in found], pa.float64()), pa.array([len(h) for h in found], pa.int64())],
                ["row", "score", "n_hits"],
            )

    whole = whole_rows(docs)
    out = whole.mapInArrow(score, with_row(whole, "score double, n_hits long"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark, sf_dir) -> DataFrame:
    """Scores of all documents by a model of the labelled ones; see ``fitted`` and ``scored``."""
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "row.doc_id",
        F.coalesce(F.expr("crc32(CAST(row.doc_id AS STRING)) % 5 = 0"), F.lit(False)).alias("held_out"),
        "score",
        "predicted",
        "n_hits",
    )
