"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

1. All tokens are counted, on the executors.  The counts table grows with the corpus;
   the ``lookup`` most frequent tokens of it travel to every task, all rarer ones are joined.
2. All tokens of training texts are modelled.  The ``classes * per_class`` most frequent ones are in classes of
   neighbouring ranks; one more class, the tail, holds all others.  P(token | history)
   is P(class | history) P(token | class, history), two softmaxes over few outcomes.  In the tail an unknown token has
   a smoothed share, and a binary tree leads to the others: to each one that is sent, and to
   buckets by the hash of rare ones.  A tree in each bucket leads on to its tokens, however many.  A step goes
   right with a probability that depends on the history, so the probabilities of all tokens and of one unknown add up to 1.
3. Logits are the logarithms of the shares in the corpus plus one row of weights for each feature of the history:
   the token before, the two before, and, skipping one, the second before.  Features are
   hashed to rows, those of the second softmax together with the class, those of a tree together with the node
   four steps lie below, each with a weight in the row.
4. Every training text is used once, in ``rounds`` parts.  In a round each task
   takes gradient steps over its texts from the common weights; changes of a row are averaged by
   the tokens that touched it, in a tree of groups of bounded size, and give the next common weights.
5. Texts are scored in blocks of tokens.  Only rare tokens of a text, with what came before them, go to the
   shelves of their buckets afterwards.  There they are counted, the trees of the buckets learn from all that
   occur in training texts, and what they add to both scores goes back to the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.llm.tables import keyed_texts, stored

END = b"\n"  # no word holds it
CLASSES, PER_CLASS = 16, 32
#: Tokens whose counts are sent to every task; all others are joined.
LOOKUP = 1 << 17
#: Rows of weights for either softmax and for the trees.
ROWS = 1 << 14
#: Leaves for rare tokens in the tree that all tasks know, at most; a bucket has any number of tokens.
BUCKETS = 1 << 17
ROUNDS = 2
RATE = 0.5
#: Steps of a tree that share a row.
_STEPS = 4
_WIDTHS = CLASSES + 1, PER_CLASS, 1 << _STEPS
_STEP = 8192
_BLOCK = 2_000_000
_COUNTED = 400_000
_SHARD = 256
#: Changes that one task adds up at once.
_FAN = 64
#: Rare tokens that one shelf of buckets holds, about.
_SHELF = 100_000
#: Logits of a step lie within it: four factors 1 + exp of it are finite.
_FAR = np.float32(21.5)
_START = np.uint64(0x5851F42D4C957F2D)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F], np.uint64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens_of(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, and the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(met: dict[bool, Counter]) -> Iterator[pa.RecordBatch]:
        for out, own in met.items():
            every = np.fromiter(own.values(), np.int64, len(own))
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(list(own), pa.binary()), "n": pa.array(every * (not out)), "every": pa.array(every)})

    met = {False: Counter(), True: Counter()}
    for batch in batches:
        for text, out in zip(batch.column("text"), batch.column("held_out").to_pylist()):
            met[out].update(tokens_of(text.as_py()))
            if len(met[False]) + len(met[True]) >= _COUNTED:
                yield from rows(met)
                met = {False: Counter(), True: Counter()}
    yield from rows(met)


def token_counts(texts: DataFrame) -> DataFrame:
    """token, n (in training texts) and every (in all) for all tokens of ``texts`` (text, held_out)."""
    return stored(texts.select("text", "held_out").mapInArrow(_counted, "token binary, n long, every long").groupBy(
        "token").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "token-counts")


def _hash(token: bytes) -> int:
    """What Spark's xxhash64 gives, without a sign."""
    return xxhash.xxh64_intdigest(token, 42)


def _buckets(hashes: np.ndarray, most: int) -> np.ndarray:
    """The buckets of rare tokens, of ``most``, a power of two."""
    return (hashes >> np.uint64(65 - most.bit_length())).astype(np.int64)


def _splits(leaves: np.ndarray) -> np.ndarray:
    """For each node of a binary tree, log(share on the right / share on the left); the children of i are 2 i and 2 i + 1."""
    room = 1 << max(len(leaves) - 1, 0).bit_length()
    sums, out = np.append(leaves, np.zeros(room - len(leaves))), np.zeros(room, np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        while len(sums) > 1:
            half = len(sums) // 2
            out[half:2 * half] = np.log(sums[1::2]) - np.log(sums[::2])
            sums = sums[::2] + sums[1::2]
    out[np.isnan(out)] = 0  # nothing on either side
    return out


@dataclass
class Vocabulary:
    """The tokens sent to all tasks, those in classes first, and the shares of the corpus."""

    tokens: list[bytes]
    counts: np.ndarray
    modelled: int
    total: int
    distinct: int
    #: By bucket of rare tokens, the sum of n + 1 over those that occur in training texts.
    buckets: np.ndarray | None = None
    shelves: int = 1

    def __post_init__(self):
        n = self.counts[:self.modelled].astype(np.float64)
        room = np.full(CLASSES * PER_CLASS, -1e9)
        room[:self.modelled] = np.log(n)
        of_class = np.zeros(CLASSES * PER_CLASS)
        of_class[:self.modelled] = n
        in_class = of_class.reshape(CLASSES, PER_CLASS).sum(1)
        self.tail_total = self.total - int(self.counts[:self.modelled].sum())
        self.tail_size = self.tail_total + (self.distinct - self.modelled) + 1
        self.class_prior = np.append(np.where(in_class > 0, np.log(np.maximum(in_class, 1)), -1e9),
                                     np.log(self.tail_total + 1)).astype(np.float32)
        self.token_prior = room.reshape(CLASSES, PER_CLASS).astype(np.float32)
        self.known = int(np.count_nonzero(self.counts))
        own = self.counts[self.modelled:self.known] + 1
        self.splits = _splits(own if self.buckets is None else np.append(own, self.buckets))
        self.hashes = np.array([_hash(t) for t in self.tokens], np.uint64)
        self.index = _Places((t, i) for i, t in enumerate(self.tokens))


class _Places(dict):
    """Places of tokens; -1 for others, which are added to ``rare``."""

    rare: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        self.rare.append(token)
        return -1


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count, of steps that grow by an eighth, that at most ``most`` tokens reach.

    Only numbers per step come to the driver.  All tokens, if there are no more of them; if more share
    the largest count, none.
    """
    step = F.floor(F.log2("every") * 6).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("every").alias("low")).collect()
    held, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r.step):
        held += r.n
        if held > most:
            break
        least = r.low
    return least


def vocabulary(counts: DataFrame, lookup: int = LOOKUP) -> Vocabulary:
    """At most ``lookup`` tokens reach the driver, and those in classes, whichever of them ``lookup`` leaves out.

    Of all others only sums by bucket do, at most :data:`BUCKETS` rows.
    """
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    least = _least_count(counts, lookup)
    modelled = counts.filter("n > 0").orderBy(F.desc("n"), "token").limit(CLASSES * PER_CLASS)
    sent = counts.filter(F.col("every") >= least)
    top = {bytes(r.token): r for rows in (modelled, sent) for r in rows.select("token", "n", "every").collect()}
    bits = BUCKETS.bit_length() - 1
    rare = counts.filter(F.col("every") < least).groupBy(
        F.shiftrightunsigned(F.xxhash64("token"), 64 - bits).alias("bucket")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0)).alias("weight"), F.count("*").alias("tokens"),
        F.sum("every").alias("every")).toArrow()
    held = np.zeros((3, BUCKETS), np.int64)
    held[:, rare["bucket"].to_numpy()] = [rare[name].to_numpy() for name in ("weight", "tokens", "every")]
    for token, r in top.items():
        if r.every < least:  # in a class
            held[:, _hash(token) >> (64 - bits)] -= r.n + 1, 1, r.every
    weight, tokens, every = held
    some = min(BUCKETS, 1 << max((int(tokens.sum()) // 8).bit_length(), 1))
    top = sorted(((t, r.n) for t, r in top.items()), key=lambda r: (-r[1], r[0]))
    modelled = sum(n > 0 for _, n in top[:CLASSES * PER_CLASS])
    return Vocabulary([t for t, _ in top], np.array([n for _, n in top], np.int64), modelled, sums.total, sums.distinct,
                      weight.reshape(some, -1).sum(1), min(some, int(every.sum()) // _SHELF + 1))


def _keys(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The features of histories, from hashes of the token before and of the second before."""
    with np.errstate(over="ignore"):
        keys = np.stack([one * _ODD[0], (one * _ODD[1] >> np.uint64(7)) + two * _ODD[2], two * _ODD[3]])
        return (keys ^ (keys >> np.uint64(32))) * _ODD[4]


class _Tokens:
    """The tokens of some texts, one behind the other: places in the vocabulary (-1: rare) and features."""

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        sizes, rare = [], []
        vocabulary.index.rare = rare

        def places() -> Iterator[Iterator[int]]:
            for text in texts:
                own = tokens_of(text)  # looked up at once: only rare tokens outlive their text
                sizes.append(len(own))
                yield map(vocabulary.index.__getitem__, own)

        self.at = np.fromiter(chain.from_iterable(places()), np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.rare, self.rare_tokens = np.flatnonzero(self.at < 0), rare
        hashes = vocabulary.hashes[self.at] if len(vocabulary.hashes) else np.empty(len(self.at), np.uint64)
        hashes[self.rare] = np.fromiter(map(_hash, rare), np.uint64, len(rare))
        self.begins = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.at)) - np.repeat(self.begins, self.sizes)
        before = []
        for back in (1, 2):
            own = np.full(len(self.at), _START)
            own[back:] = hashes[:-back]
            own[place < back] = _START
            before.append(own)
        self.keys = _keys(*before)
        self.before = [own[self.rare] >> np.uint64(32) for own in before]
        self.modelled = (self.at >= 0) & (self.at < vocabulary.modelled)
        self.classes = np.where(self.modelled, self.at // PER_CLASS, CLASSES)
        self.leaves = np.where((self.at >= vocabulary.modelled) & (self.at < vocabulary.known),
                               self.at - vocabulary.modelled, -1)
        if vocabulary.buckets is not None:
            self.buckets = _buckets(hashes[self.rare], len(vocabulary.buckets))
            self.leaves[self.rare] = self.buckets + (vocabulary.known - vocabulary.modelled)


def _rows(keys: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """The rows of features, for the second softmax with the class."""
    if classes is not None:
        with np.errstate(over="ignore"):
            keys = (keys + (classes + 1).astype(np.uint64) * _ODD[2]) * _ODD[0]
    return (keys >> np.uint64(64 - (ROWS.bit_length() - 1))).astype(np.uint16)


def _probabilities(prior: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax of the prior and the features' rows."""
    logits = weights.take(rows[0], axis=0)
    for own in rows[1:]:
        logits += weights.take(own, axis=0)
    logits += prior
    logits -= logits.T.copy().max(0)[:, None]  # whole columns, not many short rows
    np.exp(logits, out=logits)
    logits /= np.einsum("ij->i", logits)[:, None]
    return logits


def no_weights() -> list[np.ndarray]:
    """The weights of both softmaxes and of the tree, all zero."""
    return [np.zeros((ROWS, width), np.float32) for width in _WIDTHS]


def _walk(leaves: np.ndarray, keys: np.ndarray, splits: np.ndarray, weights: np.ndarray, height: int):
    """The last ``height`` steps to each leaf, in groups that share a row.

    Gives the rows (features x leaves), the places of the weights in them (steps x leaves), the logits and whether
    the step is to the right.
    """
    at = leaves + len(splits)
    for low in range(0, height, _STEPS):
        up = np.arange(low + 1, min(low + _STEPS, height) + 1)[:, None]
        nodes, below = at >> up, 1 << (low + _STEPS - up)
        rows, inside = _rows(keys, at >> (low + _STEPS)).astype(np.int64), below + (nodes & (below - 1))
        logits = splits.take(nodes)
        for own in rows:
            logits += weights.take(own * _WIDTHS[2] + inside)
        yield rows, inside, np.clip(logits, -_FAR, _FAR, out=logits), at >> (up - 1) & 1


def _height(splits: np.ndarray) -> int:
    return len(splits).bit_length() - 1


def _log_walk(leaves: np.ndarray, keys: np.ndarray, splits: np.ndarray, weights: np.ndarray, height: int) -> np.ndarray:
    """Natural logarithm of the probability of the last ``height`` steps to each leaf."""
    out = np.zeros(len(leaves))
    for _, _, logits, right in _walk(leaves, keys, splits, weights, height):
        logits *= (1 - 2 * right).astype(np.float32)
        np.exp(logits, out=logits)
        logits += 1
        out -= np.log(logits.prod(0))
    return out


def _learn_walk(leaves: np.ndarray, keys: np.ndarray, splits: np.ndarray, weights: np.ndarray, past: np.ndarray,
                touched: np.ndarray, rate: float, height: int, sums: np.ndarray) -> None:
    """A gradient step over the last steps to all leaves, as :func:`learn` takes it; in place.

    ``sums``, as large as the weights, holds zeros before and after.
    """
    for rows, inside, errors, right in _walk(leaves, keys, splits, weights, height):
        np.exp(np.negative(errors, out=errors), out=errors)
        errors += 1
        np.reciprocal(errors, out=errors)
        errors -= right.astype(np.float32)
        for own in rows:
            np.add.at(sums.reshape(-1), (own * _WIDTHS[2] + inside).reshape(-1), errors.reshape(-1))
        touched += np.bincount(rows.reshape(-1), minlength=ROWS)
    past += np.einsum("ij,ij->i", sums, sums)
    sums *= (rate / np.sqrt(past))[:, None]
    weights -= sums
    sums.fill(0)


def log_probabilities(tokens: _Tokens, vocabulary: Vocabulary, weights: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each token's probability; of a rare token that of an unknown one."""
    out, known = np.empty(len(tokens.at)), (tokens.leaves >= 0) & (tokens.at >= 0)
    for begin in range(0, len(out), _STEP):
        part = slice(begin, begin + _STEP)
        keys, classes = tokens.keys[:, part], tokens.classes[part]
        p = _probabilities(vocabulary.class_prior, weights[0], _rows(keys))
        own = np.log(np.maximum(p[np.arange(len(classes)), classes], 1e-30).astype(np.float64))
        inside = np.flatnonzero(tokens.modelled[part])
        classes = classes[inside]
        p = _probabilities(vocabulary.token_prior[classes], weights[1], _rows(keys[:, inside], classes))
        own[inside] += np.log(np.maximum(p[np.arange(len(inside)), tokens.at[part][inside] % PER_CLASS], 1e-30))
        inside = np.flatnonzero(known[part])
        own[inside] += _log_walk(tokens.leaves[part][inside], keys[:, inside], vocabulary.splits, weights[2],
                                 _height(vocabulary.splits))
        out[part] = own
    out[~tokens.modelled] -= np.log(vocabulary.tail_size)
    out[known] += np.log(max(vocabulary.tail_size - 1, 1))
    return out


def log_buckets(tokens: _Tokens, vocabulary: Vocabulary, weights: list[np.ndarray]) -> np.ndarray:
    """For each rare token, the natural logarithm of the probability of its bucket among all known tokens of the tail."""
    out = np.empty(len(tokens.rare))
    for begin in range(0, len(out), _STEP):
        part = slice(begin, begin + _STEP)
        at = tokens.rare[part]
        out[part] = _log_walk(tokens.leaves[at], tokens.keys[:, at], vocabulary.splits, weights[2],
                              _height(vocabulary.splits))
    return out


def row_sums(rows: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of ``rows`` (features x tokens), how often each occurs, and the sums of its tokens' errors.

    Equal rows lie together, as many as the next power of two by rows of zeros, those with the most first.
    Neighbours are added up in pairs, again and again, which moves no row and is faster than
    adding one after the other.
    """
    order = np.argsort(rows, axis=None, kind="stable")
    ordered = rows.ravel()[order]
    begins = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ np.uint16(1)))
    sizes = np.diff(begins, append=len(ordered))
    halvings = np.ceil(np.log2(sizes)).astype(np.int64)
    by_size = np.argsort((halvings.max() - halvings).astype(np.uint16), kind="stable")
    room = 1 << halvings[by_size]
    starts = np.empty_like(begins)
    starts[by_size] = np.cumsum(room) - room
    token = np.full(room.sum(), len(errors))
    token[np.arange(len(order)) + np.repeat(starts - begins, sizes)] = order % len(errors)
    values = np.append(errors, np.zeros((1, errors.shape[1]), errors.dtype), axis=0).take(token, axis=0)
    sums, left = np.empty((len(begins), errors.shape[1]), np.float32), len(begins)
    for done in np.bincount(halvings).tolist():
        left -= done
        sums[by_size[left:left + done]] = values[len(values) - done:]
        values = values[:len(values) - done]
        values = values[::2] + values[1::2]
    return ordered[begins], sizes, sums


def learn(tokens: _Tokens, vocabulary: Vocabulary, weights: list[np.ndarray], past: list[np.ndarray],
          touched: list[np.ndarray], rate: float) -> None:
    """Gradient steps over the tokens in order, scaled row by row by the past gradients; in place."""
    tree = np.zeros_like(weights[2])
    for begin in range(0, len(tokens.at), _STEP):
        part = slice(begin, begin + _STEP)
        keys, classes = tokens.keys[:, part], tokens.classes[part]
        inside = np.flatnonzero(tokens.modelled[part])
        own = classes[inside]
        for level, prior, rows, right in (
                (0, vocabulary.class_prior, _rows(keys), classes),
                (1, vocabulary.token_prior[own], _rows(keys[:, inside], own), tokens.at[part][inside] % PER_CLASS)):
            if not len(right):
                continue
            errors = _probabilities(prior, weights[level], rows)
            errors[np.arange(len(right)), right] -= 1
            at, sizes, sums = row_sums(rows, errors)
            past[level][at] += (sums * sums).sum(1)
            sums *= rate
            sums /= np.sqrt(past[level][at])[:, None]
            weights[level][at] -= sums
            touched[level][at] += sizes
        inside = np.flatnonzero(tokens.leaves[part] >= 0)
        _learn_walk(tokens.leaves[part][inside], keys[:, inside], vocabulary.splits, weights[2], past[2], touched[2],
                    rate, _height(vocabulary.splits), tree)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Blocks of about :data:`_BLOCK` characters with their first places; a longer text is alone."""
    block, size, begin = [], 0, 0
    for at, text in enumerate(texts):
        text = text.as_py()
        if block and size + len(text) > _BLOCK:
            yield begin, block
            block, size, begin = [], 0, at
        block.append(text)
        size += len(text)
    if block:
        yield begin, block


def _packed(level: int, shard: int, part: int, n: np.ndarray, change: np.ndarray) -> dict:
    return {"level": level, "shard": shard, "part": part, "n": n.astype(np.float32).tobytes(),
            "change": change.astype(np.float16).tobytes()}


_CHANGES = "level int, shard int, part int, n binary, change binary"


def _trained(words: Vocabulary, weights: list[np.ndarray], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [w.copy() for w in weights]
        past, touched = [np.ones(ROWS, np.float32) for _ in own], [np.zeros(ROWS) for _ in own]
        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for _, block in _blocks(batch.column("text")):
                learn(_Tokens(block, words), words, own, past, touched, rate)
        rows = [_packed(level, at // _SHARD, part, touched[level][at:at + _SHARD],
                        own[level][at:at + _SHARD] - weights[level][at:at + _SHARD])
                for level in range(len(own)) for at in range(0, ROWS, _SHARD) if touched[level][at:at + _SHARD].any()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("level", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("n", pa.binary()),
            ("change", pa.binary())]))

    return run


def _averaged(group: pd.DataFrame) -> pd.DataFrame:
    """The changes of a shard, each row averaged by the tokens that touched it."""
    level = int(group["level"].iloc[0])
    n, total = np.zeros(_SHARD), np.zeros((_SHARD, _WIDTHS[level]))
    for _, own_n, change in sorted(zip(group["part"], group["n"], group["change"])):
        own = np.frombuffer(own_n, np.float32).astype(np.float64)
        n += own
        total += own[:, None] * np.frombuffer(change, np.float16).reshape(total.shape)
    return pd.DataFrame([_packed(level, int(group["shard"].iloc[0]), int(group["part"].min()) // _FAN, n,
                                 total / np.maximum(n, 1)[:, None])])


def train(texts: DataFrame, words: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> list[np.ndarray]:
    """The weights after every text of ``texts`` was used once.

    The driver gets one row per shard of the weights and round.
    """
    weights = no_weights()
    for at in range(rounds):
        own = texts.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == at).select(
            "text", F.spark_partition_id().alias("part"))
        changes = own.mapInArrow(_trained(words, weights, rate), _CHANGES)
        for _ in range(2):
            changes = changes.withColumn("group", (F.col("part") / _FAN).cast("int")).groupBy(
                "level", "shard", "group").applyInPandas(_averaged, _CHANGES)
        for r in changes.groupBy("level", "shard").applyInPandas(_averaged, _CHANGES).collect():
            begin = r.shard * _SHARD
            weights[r.level][begin:begin + _SHARD] += np.frombuffer(r.change, np.float16).reshape(_SHARD, -1)
    return weights


_SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, "
           "rare array<struct<token: binary, shelf: int, before: long, log_bucket: float>>")


def _scored(words: Vocabulary, weights: list[np.ndarray]):
    log_n = np.log10(words.counts + 1)
    size = np.log10(words.total + words.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            if batch.num_rows:
                row = max(row, batch.column("part")[0].as_py() << 40)
            for begin, block in _blocks(batch.column("text")):
                tokens = _Tokens(block, words)
                seen = tokens.at >= 0
                base = np.full(len(tokens.at), -size)
                base[seen] += log_n[tokens.at[seen]]
                known = np.zeros(len(tokens.at), np.int64)
                known[seen] = words.counts[tokens.at[seen]] > 0
                own = log_probabilities(tokens, words, weights) / np.log(10)
                one, two = tokens.before
                shelf = tokens.buckets * words.shelves // len(words.buckets)
                rare = pa.ListArray.from_arrays(
                    pa.array(np.append(np.searchsorted(tokens.rare, tokens.begins), len(tokens.rare)), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(tokens.rare_tokens, pa.binary()), pa.array(shelf, pa.int32()),
                         pa.array((one << np.uint64(32) | two).view(np.int64)),
                         pa.array(log_buckets(tokens, words, weights), pa.float32())],
                        ["token", "shelf", "before", "log_bucket"]))
                n = len(block)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(np.arange(row, row + n)),
                    "doc_id": batch.column("doc_id").slice(begin, n),
                    "held_out": batch.column("held_out").slice(begin, n),
                    "n_tokens": pa.array(tokens.sizes, pa.int64()),
                    **{name: pa.array(np.add.reduceat(x, tokens.begins))
                       for name, x in (("known", known), ("base", base), ("own", own))},
                    "rare": rare})
                row += n

    return run


_SHARES = "row long, known long, base double, own double"


def _shelved(buckets: int, tail_size: int, rate: float):
    """What each rare token on a shelf of whole buckets adds to the row it is in.

    A token is known if it occurs in a row that is not held out.  The known ones of a bucket
    are the leaves of its tree, which learns from all that are not held out, in the order of their rows.
    """
    def run(shelf: pa.Table) -> pa.Table:
        shelf = shelf.take(pa.array(np.argsort(shelf["row"].to_numpy(), kind="stable"))).combine_chunks()
        every = shelf["token"].combine_chunks().dictionary_encode()
        token, learned = every.indices.to_numpy(), ~shelf["held_out"].to_numpy()
        n = np.bincount(token[learned], minlength=len(every.dictionary))
        bucket = _buckets(np.fromiter(map(_hash, every.dictionary.to_pylist()), np.uint64, len(n)), buckets)
        found = pc.array_sort_indices(every.dictionary).to_numpy()
        found = found[n[found] > 0].astype(np.int64)
        found = found[np.argsort(bucket[found], kind="stable")]
        _, begins, sizes = np.unique(bucket[found], return_index=True, return_counts=True)
        height = int(sizes.max(initial=1) - 1).bit_length()
        leaf_of = np.full(len(n), -1)
        leaf_of[found] = np.arange(len(found)) + np.repeat((np.arange(len(begins)) << height) - begins, sizes)
        leaves = np.zeros(len(begins) << height)
        leaves[leaf_of[found]] = n[found] + 1
        splits, leaf = _splits(leaves), leaf_of[token]
        before = shelf["before"].to_numpy().view(np.uint64)
        keys = _keys(before >> np.uint64(32), before & np.uint64(0xFFFFFFFF))
        weights, past, touched, sums = no_weights()[2], np.ones(ROWS, np.float32), np.zeros(ROWS), no_weights()[2]
        at = np.flatnonzero(learned)
        for begin in range(0, len(at), _STEP):
            own = at[begin:begin + _STEP]
            _learn_walk(leaf[own], keys[:, own], splits, weights, past, touched, rate, height, sums)
        known, score = leaf >= 0, np.zeros(len(leaf))
        at = np.flatnonzero(known)
        for begin in range(0, len(at), _STEP):
            own = at[begin:begin + _STEP]
            score[own] = _log_walk(leaf[own], keys[:, own], splits, weights, height)
        score[at] += shelf["log_bucket"].to_numpy()[at] + np.log(max(tail_size - 1, 1))
        return pa.table({"row": shelf["row"], "known": known.astype(np.int64), "base": np.log10(n + 1)[token],
                         "own": score / np.log(10)})

    return run


def score_texts(docs: DataFrame, lookup: int = LOOKUP, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Tokens are words, A-Z lower-cased, and one end.  ``base_score`` sums log10((c + 1) / (N + V + 1))
    over the tokens, with c, N and V from texts that are not held out; ``score`` is the model's log10
    probability.  A null or empty text is its end alone.  Repeated rows are counted, learned and
    scored each; rows without a doc_id are learned from.  Without training texts both scores
    are 0.  Other columns are ignored, an empty table gives no rows.
    """
    texts = keyed_texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    counts = token_counts(texts)
    words = vocabulary(counts, lookup)
    weights = train(texts.filter("not held_out"), words, rounds, rate)
    scored = stored(texts.withColumn("part", F.spark_partition_id()).mapInArrow(_scored(words, weights), _SCORED), "scored")
    shares = scored.select("row", "held_out", F.inline("rare")).groupBy("shelf").applyInArrow(
        _shelved(len(words.buckets), words.tail_size, rate), _SHARES).groupBy("row").agg(
        *(F.sum(name).alias(f"rare_{name}") for name in ("known", "base", "own")))

    def whole(name: str) -> Column:
        return F.col(name) + F.coalesce(f"rare_{name}", F.lit(0))

    return scored.drop("rare").join(shares, "row", "left").select(
        "doc_id", "held_out", "n_tokens", whole("known").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), whole("base").alias("base_score"),
        whole("own").alias("score"))


def op13_lm_scores(spark, folder: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{folder}/documents.parquet"))
