"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taskfold.llm import bytetext as bt
from taskfold.llm.tables import stored, table

U = np.uint64
BLOCK_BYTES = 16 << 20
BATCH = 2048
#: Tokens whose probabilities are computed at a time, and of these against all groups: few, so that scores stay in the cache.
TOKENS, FEW = 1 << 16, 1 << 11
#: Tokens of one group that are multiplied with its noise at a time.
BLOCK = 8
#: Tokens of a block of texts that are scored at a time; a longer text is alone.
RUN = 1 << 18


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7


@dataclass
class LogBilinear:
    """P(outcome | two words before), in two factors: the group of the outcome, then the outcome among its group.

    Both are log-bilinear in one context vector: the sum of the input vectors of both words, each weighed
    dimension by dimension. Outcomes are words, classes of all other words, and the end of a text, which
    also stands before its beginning; ``width`` neighbours in the order of frequency are a group, so that a
    normalised probability takes about twice the square root of the outcomes. The last column of ``outputs``
    and ``groups`` is a bias.
    """

    words: np.ndarray  # hashes, in order
    of_word: np.ndarray  # their outcomes
    of_class: np.ndarray  # outcomes of the classes
    end: int
    width: int
    frequency: np.ndarray  # of the outcomes in the training texts
    inputs: np.ndarray
    outputs: np.ndarray
    groups: np.ndarray
    mixing: np.ndarray  # weights of the dimensions for the last word, and for the one before

    @classmethod
    def started(cls, words: np.ndarray, counts: np.ndarray, classes: np.ndarray, ends: int, size: int) -> LogBilinear:
        """Untrained: small random vectors, and biases that give each outcome its frequency."""
        rng, all_counts = np.random.default_rng(1), np.concatenate([counts, classes, [ends]]) + 0.5
        n = len(all_counts)
        order = np.argsort(-all_counts, kind="stable")
        outcome = np.empty(n, np.int64)
        outcome[order] = np.arange(n)
        frequency, width = all_counts[order] / all_counts.sum(), math.ceil(math.sqrt(n))
        mass = np.add.reduceat(frequency, np.arange(0, n, width))
        vectors = lambda rows: rng.normal(0, 0.1, (rows, size)).astype(np.float32)
        biased = lambda share: np.hstack([vectors(len(share)), np.log(share)[:, None].astype(np.float32)])
        inside = frequency / mass[np.arange(n) // width]
        return cls(words, outcome[: len(words)], outcome[len(words) : n - 1], int(outcome[-1]), width, frequency, vectors(n),
                   biased(inside), biased(mass), np.array([np.ones(size), np.full(size, 0.5)], np.float32))

    def numbers(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Outcomes of words."""
        other = self.of_class[class_of(endings, len(self.of_class))]
        if not len(self.words):
            return other
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.of_word[at], other)

    def contexts(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Context vectors, and a one for the bias."""
        out = np.ones((len(far), self.inputs.shape[1] + 1), np.float32)
        out[:, :-1] = _rows(self.inputs, near) * self.mixing[0] + _rows(self.inputs, far) * self.mixing[1]
        return out

    def log_probability(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised by batched matrix products: over the groups, then over one group."""
        out = np.empty(len(word))
        for i in range(0, len(word), TOKENS):
            part = slice(i, i + TOKENS)
            of_part, own = word[part], out[part]
            context, group = self.contexts(far[part], near[part]), of_part // self.width
            for j in range(0, len(group), FEW):
                own[j : j + FEW] = _log_share(context[j : j + FEW], self.groups, group[j : j + FEW])
            order = np.argsort(of_part)
            cuts = np.searchsorted(group[order], np.arange(len(self.groups) + 1))
            for g in np.flatnonzero(np.diff(cuts)):
                first = g * self.width
                for j in range(cuts[g], cuts[g + 1], FEW):
                    at = order[j : min(j + FEW, cuts[g + 1])]
                    own[at] += _log_share(_rows(context, at), self.outputs[first : first + self.width], of_part[at] - first)
        return out


def _log_share(context: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """log of exp(score chosen) / sum of exp(score), context by context; scores are products with the rows."""
    scores = context @ rows.T
    most = math.sqrt(np.einsum("ij,ij->i", context, context).max() * np.einsum("ij,ij->i", rows, rows).max())
    # beyond 60 a sum of exponentials might leave single precision
    if not most <= 60 and max(scores.max(), -scores.min()) > 60:
        scores -= scores.max(axis=1, keepdims=True)
    own = scores[np.arange(len(chosen)), chosen]
    return own - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))


def class_of(endings, classes: int):
    """The class of a word of no outcome of its own, by its last three bytes (as numbers or as a column)."""
    spread = endings * 2654435761
    return F.pmod(F.shiftright(spread, 16), F.lit(classes)) if isinstance(endings, Column) else (spread >> 16) % classes


class Trainer:
    """Noise-contrastive estimation of both factors: tell each true outcome from noise drawn by frequency.

    The noise is shared in a batch: that of the groups by all tokens, that of one group's outcomes by its tokens. A
    step touches only the rows that occur in it, so its cost doesn't depend on the number of outcomes.
    """

    def __init__(self, model: LogBilinear, noise: int, rate: float, seed: int):
        self.tables = {k: getattr(model, k).copy() for k in ("inputs", "outputs", "groups", "mixing")}
        self.m = replace(model, **self.tables)
        self.noise, self.inner, self.rate, self.rng = noise, max(1, noise // 2), rate, np.random.default_rng(seed)
        self.cumulated = np.concatenate([[0], np.cumsum(model.frequency)])
        self.cuts = np.minimum(np.arange(len(model.groups) + 1) * model.width, len(model.frequency))
        mass = np.diff(self.cumulated[self.cuts])
        self.log_groups = np.log(self.noise * mass).astype(np.float32)
        self.log_inside = np.log(self.inner * model.frequency / mass[np.arange(len(model.frequency)) // model.width]).astype(np.float32)
        self.squares = {k: np.full(v.shape, 1e-8, np.float32) for k, v in self.tables.items()}
        self.counts = np.zeros(len(model.frequency), np.int64)
        self.steps = 0

    @property
    def batch(self) -> int:
        """Tokens of the next step: few at first, so that a small share of the texts also makes many steps."""
        return min(BATCH, 64 + 4 * self.steps)

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        m, n = self.m, len(word)
        self.steps += 1
        self.counts += np.bincount(word, minlength=len(self.counts))
        order = np.argsort(word)
        far, near, word = far[order], near[order], word[order]
        context, group = m.contexts(far, near), word // m.width
        first, of_group = _firsts(word), _firsts(group)
        groups = group[of_group]
        drawn = np.searchsorted(self.cumulated, self.rng.random(self.noise), "right") - 1
        drawn = np.minimum(drawn, len(self.counts) - 1) // m.width
        true, false = _rows(m.groups, group), _rows(m.groups, drawn)
        up = _sigmoid(self.log_groups[group] - np.einsum("ij,ij->i", context, true))[:, None]
        down = _sigmoid(context @ false.T - self.log_groups[drawn])
        to_context = up * true - down @ false
        pulled = np.add.reduceat(up * context, of_group)
        self._move("groups", np.concatenate([groups, drawn]), np.concatenate([pulled, -(down.T @ context)]), n)
        low, high = self.cuts[groups, None], self.cuts[groups + 1, None]
        start, end = self.cumulated[low], self.cumulated[high]
        drawn = np.searchsorted(self.cumulated, start + self.rng.random((len(groups), self.inner)) * (end - start), "right") - 1
        drawn = np.clip(drawn, low, high - 1)
        # tokens of a group lie in blocks of a few, filled up with zeros, so that all blocks are multiplied at once
        counts = np.diff(np.append(of_group, n))
        blocks = -(-counts // BLOCK)
        begin = np.cumsum(blocks) - blocks
        place = np.arange(n) + np.repeat(begin * BLOCK - of_group, counts)
        packed = np.zeros((blocks.sum() * BLOCK, context.shape[1]), np.float32)
        packed[place] = context
        packed, of_block = packed.reshape(-1, BLOCK, context.shape[1]), np.repeat(np.arange(len(groups)), blocks)
        true, false = _rows(m.outputs, word), _rows(_rows(m.outputs, drawn), of_block)
        up = _sigmoid(self.log_inside[word] - np.einsum("ij,ij->i", context, true))[:, None]
        down = _sigmoid(packed @ false.transpose(0, 2, 1) - self.log_inside[drawn][of_block][:, None, :])
        to_context += up * true - _rows((down @ false).reshape(-1, context.shape[1]), place)
        pushed = down.transpose(0, 2, 1) @ packed
        pushed = np.add.reduceat(pushed.reshape(len(of_block), -1), begin).reshape(drawn.size, -1)
        pulled = np.add.reduceat(up * context, first)
        self._move("outputs", np.concatenate([word[first], drawn.ravel()]), np.concatenate([pulled, -pushed]), n)
        to_context, x, y = to_context[:, :-1], _rows(m.inputs, near), _rows(m.inputs, far)
        mixing = np.stack([(to_context * x).sum(axis=0), (to_context * y).sum(axis=0)])
        self._move("inputs", np.concatenate([near, far]), np.concatenate([to_context * m.mixing[0], to_context * m.mixing[1]]), n)
        self._move("mixing", np.arange(2), mixing, n)

    def _move(self, name: str, rows: np.ndarray, steps: np.ndarray, tokens: int) -> None:
        """Adds to the rows of a table what their steps, summed, say (AdaGrad)."""
        order = np.argsort(rows)
        rows = rows[order]
        first = _firsts(rows)
        g, at = np.add.reduceat(_rows(steps, order), first) / np.float32(tokens), rows[first]
        squares = _rows(self.squares[name], at) + g * g
        self.squares[name][at] = squares
        self.tables[name][at] = _rows(self.tables[name], at) + np.float32(self.rate) * g / np.sqrt(squares)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table; faster than an index where they are short."""
    return table.take(at, axis=0)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where new values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def hashed_words(data: np.ndarray, offsets: np.ndarray):
    """(hashes, last three bytes as a number, text number) of all words in lower case."""
    hashes, owner, start, end = bt.hashed_words(data, offsets, bt.BY_SPACE)
    endings = np.zeros(len(hashes), np.int64)
    for back in (1, 2, 3):
        inside = end - back >= start
        endings[inside] += bt.LOWER[data[end[inside] - back]].astype(np.int64) << (8 * (back - 1))
    return hashes, endings, owner


def _sequences(model: LogBilinear, outcomes: np.ndarray, owner: np.ndarray, n_texts: int):
    """(word before the last, last word, word, text number, is an end) of all tokens, each text followed by its end."""
    counts = np.bincount(owner, minlength=n_texts) if len(owner) else np.zeros(n_texts, np.int64)
    ends = np.cumsum(counts + 1) - 1
    word = np.empty(len(outcomes) + n_texts, np.int64)
    is_end = np.zeros(len(word), bool)
    is_end[ends] = True
    word[~is_end] = outcomes
    word[is_end] = model.end
    near = np.concatenate([[model.end], word[:-1]])
    far = np.concatenate([[model.end, model.end], word[:-2]])[: len(word)]
    # a text begins after an end; what stood before that end doesn't count
    first = np.flatnonzero(np.concatenate([[True], is_end[:-1]]))
    far[first] = model.end
    return far, near, word, np.repeat(np.arange(n_texts), counts + 1), is_end


def _counter(docs_of_block: pa.Table) -> pa.Table:
    """The distinct words of a block, how often its training texts have each, and how each ends."""
    found = []
    block = docs_of_block.column("block")[0].as_py()
    learn = docs_of_block.column("learn").to_numpy()
    for first, end, data, offsets in bt.slices(docs_of_block.column("text").combine_chunks()):
        h, endings, owner = hashed_words(data, offsets)
        found.append(_summed_counts(h, learn[first:end][owner].astype(np.int64), endings))
    hashes, counts, endings = _summed_counts(*(np.concatenate(x) for x in zip(*found)))
    return pa.table({"block": pa.array(np.full(len(hashes), block, np.int64)), "hash": hashes.view(np.int64), "c": counts, "ending": endings})


def _summed_counts(hashes: np.ndarray, weights: np.ndarray, endings: np.ndarray):
    order = np.argsort(hashes)
    h, w = hashes[order], weights[order]
    first = _firsts(h)[: len(h)]
    return h[first], np.add.reduceat(w, first) if len(h) else w, endings[order][first]


def _blocked(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The texts with the block of each, and how many blocks there are."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    left = remainder(F.col("doc_id"))
    return slim.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
        "doc_id",
        "text",
        F.coalesce(left == 2, F.lit(False)).alias("held_out"),
        F.coalesce(left != 2, F.lit(False)).alias("learn"),
    ), blocks


def trained(docs: DataFrame, model: LogBilinear, copies: int, noise: int = 16, rate: float = 0.05) -> LogBilinear:
    """The model after one pass over all training texts.

    Each of ``copies`` models is trained on its share of the texts. Shares and the order in them depend on the
    rows alone, not on how they lie on the cluster. The copies are averaged row by row, weighed by how often
    each copy met the outcome, in an aggregate; only the average, whose size is the model's, goes to the driver.
    """
    size = model.inputs.shape[1]
    names = [f"x{i}" for i in range(2 * size + 1)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows_of(trainer: Trainer) -> pa.RecordBatch:
        m, n = trainer.m, len(trainer.counts)
        by_group = np.add.reduceat(trainer.counts, np.arange(0, n, m.width))
        flat = lambda x: np.pad(x, ((0, 0), (0, len(names) - x.shape[1])))
        rows = np.vstack([np.hstack([m.inputs, m.outputs]), flat(m.groups), flat(m.mixing.reshape(1, -1))])
        weights = np.concatenate([trainer.counts, by_group, [trainer.counts.sum()]])
        met = np.flatnonzero(weights)
        columns = [pa.array(met), pa.array(weights[met])] + [pa.array(rows[met, i]) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, ["row", "weight", *names])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy, trainer, rest = None, None, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]])) if len(numbers) else [0]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if numbers[low] != copy:
                    if trainer is not None:
                        trainer.step(*rest) if len(rest[0]) else None
                        yield rows_of(trainer)
                    copy, trainer, rest = numbers[low], Trainer(shared.value, noise, rate, 7), [np.empty(0, np.int64)] * 3
                for first, end, data, offsets in bt.slices(batch.column(1).slice(low, high - low)):
                    h, endings, owner = hashed_words(data, offsets)
                    new = _sequences(shared.value, shared.value.numbers(h, endings), owner, end - first)[:3]
                    rest, at = [np.concatenate(x) for x in zip(rest, new)], 0
                    while len(rest[0]) - at >= (n := trainer.batch):
                        trainer.step(*(x[at : at + n] for x in rest))
                        at += n
                    rest = [x[at:] for x in rest]
        if trainer is not None:
            trainer.step(*rest) if len(rest[0]) else None
            yield rows_of(trainer)

    schema = "row long, weight long, " + ", ".join(f"{n} float" for n in names)
    key = F.xxhash64("doc_id", "text")
    dealt = docs.filter("learn").select(F.pmod(F.shiftright(key, 20), F.lit(copies)).alias("copy"), "text", key.alias("key"))
    dealt = dealt.repartition(copies, "copy").sortWithinPartitions("copy", "key").select("copy", "text")
    mean = dealt.mapInArrow(learn, schema).groupBy("row").agg(*[(F.sum(F.col(n) * F.col("weight")) / F.sum("weight")).alias(n) for n in names])
    found = mean.toArrow()
    at = found.column("row").to_numpy()
    values = np.stack([found.column(n).to_numpy() for n in names], axis=1).astype(np.float32) if len(at) else None
    n, groups = len(model.frequency), len(model.groups)
    new = {k: getattr(model, k).copy() for k in ("inputs", "outputs", "groups", "mixing")}
    if len(at):
        one, group, last = at < n, (at >= n) & (at < n + groups), at == n + groups
        new["inputs"][at[one]], new["outputs"][at[one]] = values[one, :size], values[one, size:]
        new["groups"][at[group] - n] = values[group, : size + 1]
        new["mixing"] = values[last][0, : 2 * size].reshape(2, size)
    return replace(model, **new)


def _words_of_own(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent words, at most ``most`` of them and all of those with about equal counts or none; the others."""
    seen = counts.filter("c > 0").withColumn("level", F.floor(F.log2("c") * 512))
    least, so_far = math.inf, 0
    for level, n in sorted(seen.groupBy("level").count().collect(), reverse=True):
        so_far += n
        if so_far > most:
            break
        least = level
    own = F.col("level") >= F.lit(least if least < math.inf else 1 << 40)
    return seen.filter(own), seen.filter(~own)


def scored(docs: DataFrame, per_root: int = 8, size: int = 16, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Learns from the rows whose crc32 of doc_id, modulo 7, isn't 2; those with 2 are held out; rows with a null
    doc_id are neither. Tokens are the words in lower case, then one end. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) over them. ``score`` is the model's log10 probability of the text.

    The model's vocabulary grows with the distinct training words V: the ``per_root`` * sqrt(V) most frequent ones
    have outcomes of their own, all others fall into a quarter as many classes by their last three bytes. In a class a word has
    a share of (c + 1) / (tokens + words of the class + 1); so it sums to one over all words, one unknown word of each class
    included. The root keeps the model, a table that each task holds, small beside the counts: 132 bytes an
    outcome, 13 MB where V is 10**8.

    Counts of words can't be sent to all tasks, as they grow with the corpus. The texts are dealt into blocks of
    about ``block_bytes``; a block asks for its distinct words, and gets back the counts of those that other
    blocks have too. A word's rows are at most one per block, however often it occurs.

    Null and empty texts have the end alone. Repeated rows count as often as they occur. Without training texts N
    and V are 0 and all outcomes are equally likely. The same rows give the same scores, but for the last digits of single precision.
    """
    spark = docs.sparkSession
    blocked, blocks = _blocked(docs, block_bytes)
    asked = stored(blocked.groupBy("block").applyInArrow(_counter, "block long, hash long, c long, ending long"), "words")
    counts = asked.groupBy("hash").agg(F.sum("c").alias("c"), F.count("*").alias("blocks"), F.min("ending").alias("ending"))
    counts = stored(counts, "counts")
    total, known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    texts = blocked.filter("learn").count()
    most = math.ceil(per_root * math.sqrt(known))
    classes = max(1, most // 4)
    frequent, rare = _words_of_own(counts, most)
    frequent = frequent.select("hash", "c").toArrow()
    hashes = frequent.column("hash").to_numpy().view(U)
    order = np.argsort(hashes)
    rare_tokens, rare_words = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for c, tokens, words in rare.groupBy(class_of(F.col("ending"), classes)).agg(F.sum("c"), F.count("*")).collect():
        rare_tokens[c], rare_words[c] = tokens, words
    model = LogBilinear.started(hashes[order], frequent.column("c").to_numpy()[order], rare_tokens, texts, size)
    model = trained(blocked, model, math.ceil(2 * math.sqrt(blocks)))

    # of an outcome that is a class: by what its words' counts are divided
    rest = np.zeros(len(model.frequency), np.int64)
    rest[model.of_class] = rare_tokens + rare_words + 1
    shared = spark.sparkContext.broadcast((model, rest))
    all_tokens = int(total) + texts
    base_of = all_tokens + (int(known) + (texts > 0)) + 1
    replies = asked.alias("q").join(counts.filter("blocks > 1").alias("w"), "hash").filter("q.c <> w.c").select("block", "hash", F.col("w.c").alias("c"))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        return _scored_block(own, told, *shared.value, texts, all_tokens, base_of)

    return blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, result)


def _scored_block(own: pa.Table, told: pa.Table, model: LogBilinear, rest: np.ndarray, texts: int, all_tokens: int, base_of: int) -> pa.Table:
    """The scores of a block's texts; ``told`` has the counts of its words that differ from those of the block itself.

    Only a word's number is kept for all tokens of the block, beside its text; the arrays that scoring needs are those of a run.
    """
    n = own.num_rows
    if not n:
        return pa.table({n: pa.array([], t) for n, t in _RESULT.items()})
    hashes, endings, same, owner = _numbered_words(own.column("text").combine_chunks())
    c = np.bincount(same, own.column("learn").to_numpy()[owner], len(hashes)).astype(np.int64)
    c[np.searchsorted(hashes, told.column("hash").to_numpy().view(U))] = told.column("c").to_numpy()
    outcomes = model.numbers(hashes, endings)
    tokens = np.bincount(owner, minlength=n) + 1
    known_tokens, base, scores = (np.empty(n) for _ in range(3))
    start = np.concatenate([[0], np.cumsum(tokens - 1)])
    first = 0
    while first < n:
        end = min(n, max(first + 1, int(np.searchsorted(start, start[first] + RUN, "right")) - 1))
        words = same[start[first] : start[end]]
        far, near, word, text, is_end = _sequences(model, outcomes[words], owner[start[first] : start[end]] - first, end - first)
        count = np.full(len(word), texts)
        count[~is_end] = c[words]
        logs = model.log_probability(far, near, word) / np.log(10)
        rare = rest[word] > 0
        logs[rare] += np.log10((count[rare] + 1) / rest[word[rare]])
        for out, weights in ((known_tokens, count > 0), (base, np.log10((count + 1) / base_of)), (scores, logs)):
            out[first:end] = np.bincount(text, weights, end - first)
        first = end
    return pa.table({
        "doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "n_tokens": tokens.astype(np.int64), "n_known": known_tokens.astype(np.int64),
        "train_tokens": np.full(n, all_tokens), "base_score": base, "score": scores,
    })


def _numbered_words(column: pa.Array):
    """(hashes, last three bytes) of the distinct words, ordered by hash; (number of the word, text number) of all tokens."""
    found = []
    for first, _, data, offsets in bt.slices(column):
        h, endings, owner = hashed_words(data, offsets)
        found.append((h, endings.astype(np.int32), (owner + first).astype(np.int32)))
    h, endings, owner = (np.concatenate(x) for x in zip(*found))
    del found
    order = np.argsort(h)
    h = h[order]
    first = _firsts(h)[: len(h)]
    same = np.empty(len(h), np.int32)
    same[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(h))))
    return h[first], endings[order[first]].astype(np.int64), same, owner


_RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
           "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def op9_lm_scoring(spark, sf_dir) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
