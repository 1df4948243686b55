"""Phrases of a collection that belong together, counted on a prefix-free parse of its texts.

1. A text is a sequence of words and breaks (ends of pieces).  It is cut behind words chosen by
   their content, into chunks that overlap by the two words a longest phrase may reach
   back.  As cuts depend on nothing but the words, copies of a passage give the same chunks
   wherever they stand.  Chunks with their numbers of occurrences are the dictionary; a text with
   a thousand copies is looked at once from here on.
2. Words and phrases are counted inside the different chunks, weighted.  A phrase belongs
   to the chunk in which it ends behind the overlap, so each occurrence counts once.
3. Rare phrases are kept out of the shuffle level by level: first 64-bit hashes of words and pairs are counted, then
   those of triples whose pairs are frequent, in blocks of numbers.  A phrase can be
   frequent only if its hash is.  Frequent hashes make Bloom filters of a stated largest size, and a last pass
   counts, as text, the phrases that may be frequent.  Filters save work and decide
   nothing: what passes by chance has its exact count.
4. Counts of the parts are joined to the candidates, hot parts spread over several tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cloakframe.llm.tables import kept_in_process, stored
from cloakframe.operators.spread import heavy_join

LEAST = 10
KEEP_PERCENT = 50
TOP = 2000
#: Words of a longest phrase; fixed by the scores' formula of two cuts.
_LONGEST = 3
_OVERLAP = _LONGEST - 1
#: One word in so many ends a chunk.
TRIGGER = 32
#: Bits of the filter of frequent pairs: 16 for each of them, at least and at most so many.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Different chunks or phrases, and hashes, that a task counts before it passes them on.
_COUNTED = 120_000
_HASHED = 2_000_000
#: Words and breaks that are counted as text at once.
_TOKENS = 1_000_000
#: Hashes, on average, that one task puts together from all others.
_MERGED = 1_000_000
_BREAK = b"\xff"  # never part of UTF-8
_SIGNS = bytes(ord(_BREAK) if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_and_breaks(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, and a break wherever a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(_SIGNS).replace(_BREAK, b" \xff ").split()


def _ends_chunk(trigger: int):
    return lambda word: xxhash.xxh3_64_intdigest(word) % trigger == 0


def chunks(tokens: list[bytes], ends: dict) -> list[tuple[bytes, bool]]:
    """The chunks of a sequence, words joined by blanks, and whether it is the first one."""
    out, begin = [], 0
    for at in [i for i, end in enumerate(map(ends.__getitem__, tokens)) if end]:
        if at - begin >= _OVERLAP:
            out.append((b" ".join(tokens[begin:at + 1]), begin == 0))
            begin = at + 1 - _OVERLAP
    if tokens and (not out or begin + _OVERLAP < len(tokens)):
        out.append((b" ".join(tokens[begin:]), begin == 0))
    return out


def _parse(trigger: int):
    def rows(met: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang for lang, _, _ in met], pa.string()),
            "chunk": pa.array([chunk for _, chunk, _ in met], pa.binary()),
            "first": pa.array([first for _, _, first in met], pa.bool_()),
            "size": pa.array([chunk.count(b" ") + 1 for _, chunk, _ in met], pa.int64()),
            "n": pa.array(list(met.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = kept_in_process("chunk ends", trigger, lambda: _ends_chunk(trigger))
        met: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang = lang.as_py()
                met.update((lang, *chunk) for chunk in chunks(words_and_breaks(text.as_py()), ends))
                if len(met) >= _COUNTED:
                    yield rows(met)
                    met = Counter()
        yield rows(met)

    return run


def dictionary(docs: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """lang, chunk, first, size (words and breaks) and n: the different chunks and how often each occurs."""
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = texts.mapInArrow(_parse(trigger), "lang string, chunk binary, first boolean, size long, n long")
    return stored(parts.groupBy("lang", "chunk", "first", "size").agg(F.sum("n").alias("n")), "chunks")


def _hash_of(word: bytes) -> int:
    return 0 if word == _BREAK else xxhash.xxh3_64_intdigest(word) | 1


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Odd hashes of the couples; 0 where one of them is 0."""
    with np.errstate(over="ignore"):
        out = left * _MIX
        out = ((out ^ (out >> np.uint64(31))) + right) * _MIX
        out ^= out >> np.uint64(29)
    return np.where((left != 0) & (right != 0), out | np.uint64(1), np.uint64(0))


class _Sequence:
    """All chunks of one language in a batch, one behind the other, with breaks between them.

    ``words``, ``pairs`` and ``triples`` hold the hashes of the phrases that end at a place, 0 if there is none;
    ``weight`` how often they count; ``own`` the hashes of the words whatever the language.
    """

    def __init__(self, lang: str, chunks: list[bytes], first: np.ndarray, n: np.ndarray, known: dict):
        self.tokens = b" \xff ".join(chunks).split()
        own = self.own = np.fromiter(map(known.__getitem__, self.tokens), np.uint64, len(self.tokens))
        self.words = _mixed(own, np.full(len(own), xxhash.xxh3_64_intdigest(lang) | 1, np.uint64))
        self.pairs = np.zeros_like(own)
        self.pairs[1:] = _mixed(self.words[:-1], own[1:])
        sizes = np.array([c.count(b" ") + 2 for c in chunks])
        sizes[-1] -= 1
        begins = np.cumsum(sizes) - sizes
        self.weight = np.repeat(n, sizes)
        place = np.arange(len(own)) - np.repeat(begins, sizes)
        self.weight[(place < np.repeat(np.where(first, 0, _OVERLAP), sizes)) | (own == 0)] = 0

    def triples(self) -> np.ndarray:
        out = np.zeros_like(self.pairs)
        out[1:] = _mixed(self.pairs[:-1], self.pairs[1:])
        return out

    def extend(self, others: list[_Sequence]) -> None:
        """The others behind this one, with breaks between them."""
        for x in others:
            self.tokens += [_BREAK, *x.tokens]
        nothing = np.zeros(1, np.uint64)
        for field in ("own", "words", "pairs", "weight"):
            parts = [getattr(self, field)]
            for x in others:
                parts += [nothing.astype(parts[0].dtype), getattr(x, field)]
            setattr(self, field, np.concatenate(parts))


def _sequences(batch: pa.RecordBatch, known: dict) -> Iterator[tuple[str, _Sequence]]:
    langs = np.array(batch.column("lang").to_pylist(), object)
    texts = np.array(batch.column("chunk").to_pylist() + [None], object)[:-1]
    first, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        yield lang, _Sequence(lang, texts[own].tolist(), first[own], n[own], known)


def _summed(every: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes, ascending, with their sums; none of them is 0."""
    order = np.argsort(every)
    every, weight = every[order], weight[order]
    begins = np.flatnonzero(np.diff(every, prepend=np.uint64(0)))
    return every[begins], np.add.reduceat(weight, begins) if len(begins) else weight


def _counted(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for hashes that count once each, which need no order of their weights."""
    every = np.sort(every)
    begins = np.flatnonzero(np.diff(every, prepend=np.uint64(0)))
    return every[begins], np.diff(begins, append=len(every))


def _hashes(bits: int, lower: np.ndarray | None):
    """Blocks of counted hashes by their first ``bits``: words and pairs, or with ``lower``, the filter
    of frequent pairs, triples of frequent pairs."""
    def blocks(hashes: list[np.ndarray], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, weight = np.concatenate(hashes), np.concatenate(weights)
        once = weight == 1
        yield block(*_counted(every[once]))
        yield block(*_summed(every[~once], weight[~once]))

    def block(every: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        bucket = (every >> np.uint64(64 - bits)).astype(np.int64)
        begins = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(begins[1:], len(bucket))
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(bucket[begins], pa.int64()),
            "hashes": pa.array([every[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
            "counts": pa.array([weight[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_in_process("word hashes", None, lambda: _hash_of)
        hashes, weights, held = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            for _, own in _sequences(batch, known):
                if lower is None:
                    levels = [own.words, own.pairs]
                else:
                    often = _may_be_frequent(own.pairs, lower)
                    levels = [np.where(often & np.roll(often, 1), own.triples(), np.uint64(0))]
                for level in levels:
                    counts = (own.weight > 0) & (level != 0)
                    hashes.append(level[counts])
                    weights.append(own.weight[counts])
                    held += len(hashes[-1])
            if held >= _HASHED:
                yield from blocks(hashes, weights)
                hashes, weights, held = hashes[:1], weights[:1], 0
        yield from blocks(hashes, weights)

    return run


def _frequent(least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        every, total = _summed(np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]]),
                               np.concatenate([np.frombuffer(x, np.int64) for x in group["counts"]]))
        return pd.DataFrame({"hash": every[total >= least].view(np.int64)})

    return run


def frequent_filter(chunked: DataFrame, least: int, most_bits: int, lower: np.ndarray | None = None) -> np.ndarray:
    """The Bloom filter of words and pairs, or of triples of frequent pairs, that occur ``least`` times."""
    words = chunked.agg(F.sum("size")).first()[0] or 0
    bits = max(4, (words // _MERGED).bit_length())
    blocks = chunked.mapInArrow(_hashes(bits, lower), "bucket long, hashes binary, counts binary")
    found = stored(blocks.groupBy("bucket").applyInPandas(_frequent(least), "hash long"), "frequent-hashes")
    return bloom_filter(found, most_bits=most_bits)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each hash."""
    with np.errstate(over="ignore"):
        return hashes % np.uint64(bits), (hashes * _MIX >> np.uint64(20)) % np.uint64(bits)


def _bits_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_places(np.asarray(batch.column("hash")).view(np.uint64), bits))
            places = np.unique(places)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array((places >> np.uint64(6)).astype(np.int64), pa.int64()),
                "mask": pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64), pa.int64())})

    return run


def bloom_filter(hashes: DataFrame, least_bits: int = LEAST_BITS, most_bits: int = MOST_BITS) -> np.ndarray:
    """The bytes of the filter; with 2**28 bits, the most, 32 MB are collected.

    The executors set the bits, so the hashes themselves never reach the driver.
    """
    wanted = 16 * hashes.count()
    bits = least_bits
    while bits < min(wanted, most_bits):
        bits *= 2
    words = hashes.mapInArrow(_bits_of(bits), "word long, mask long").groupBy("word").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("mask"))
    return out.view(np.uint8)


def _may_be_frequent(hashes: np.ndarray, filter_bits: np.ndarray) -> np.ndarray:
    yes = hashes != 0
    for place in _places(hashes, 8 * len(filter_bits)):
        place = place.astype(np.int64)
        yes &= (filter_bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return yes


def _numbers(tokens: list[bytes], own: np.ndarray) -> np.ndarray:
    """A number for each different token; equal hashes of different tokens are noticed."""
    order = np.argsort(own)
    begins = np.diff(own[order], prepend=np.uint64(0)) != 0
    begins[:1] = True
    numbers = np.empty(len(own), np.int64)
    numbers[order] = np.cumsum(begins) - 1
    first = order[begins]
    same = map(eq, tokens, map(tokens.__getitem__, first[numbers].tolist()))
    if all(same):
        return numbers
    places: dict[bytes, int] = {}
    return np.array([places.setdefault(t, len(places)) for t in tokens])


def _texts(tokens: list[bytes], own: np.ndarray, weight: np.ndarray,
           ends: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[list[bytes], list[int]]:
    """The different phrases of one to three tokens that end at the given places, and the sums of their weights."""
    numbers = _numbers(tokens, own)
    base = int(numbers.max()) + 1 if len(numbers) else 1
    if base >= 1 << 21:  # three numbers would not fit 64 bits
        numbers = numbers.astype(object)
    phrases, sums = [], []
    for length, at in enumerate(ends):
        codes = numbers[at]
        for back in range(1, length + 1):
            codes = numbers[at - back] * base ** back + codes
        order = np.argsort(codes)
        ordered = codes[order]
        begins = np.append(np.flatnonzero(ordered[:1] == ordered[:1]), np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
        if len(begins):
            phrases += [b" ".join(tokens[i - length:i + 1]) for i in at[order[begins]].tolist()]
            sums += np.add.reduceat(weight[at[order]], begins).tolist()
    return phrases, sums


def _phrases(short: np.ndarray, long: np.ndarray):
    """Counts of the phrases that pass the filters, and of all words together, as the empty phrase."""
    def rows(lang: str, held: list[_Sequence]) -> Iterator[pa.RecordBatch]:
        phrases, sums = [b""], [sum(int(x.weight.sum()) for x in held)]
        block = held[0]
        block.extend(held[1:])
        counts = block.weight > 0
        ends = (np.flatnonzero(_may_be_frequent(block.words, short) & counts),
                np.flatnonzero(_may_be_frequent(block.pairs, short) & counts),
                np.flatnonzero(_may_be_frequent(block.triples(), long) & counts))
        found, totals = _texts(block.tokens, block.own, block.weight, ends)
        phrases += found
        sums += totals
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(phrases), pa.string()),
            "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "n": pa.array(sums, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_in_process("word hashes", None, lambda: _hash_of)
        held: dict[str, list[_Sequence]] = {}
        size = 0
        for batch in batches:
            for lang, own in _sequences(batch, known):
                held.setdefault(lang, []).append(own)
                size += len(own.tokens)
            if size >= _TOKENS:
                for lang in held:
                    yield from rows(lang, held[lang])
                held, size = {}, 0
        for lang in held:
            yield from rows(lang, held[lang])

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, trigger: int = TRIGGER,
                  most_bits: int = MOST_BITS) -> DataFrame:
    """lang, phrase and n: all phrases of one to three words that occur ``least`` times.

    Exact counts within pieces, overlapping occurrences included.  The empty phrase counts all words
    of a language.
    """
    chunked = dictionary(docs, trigger)
    short = frequent_filter(chunked, least, most_bits)
    long = frequent_filter(chunked, least, most_bits, short)
    counted = chunked.mapInArrow(_phrases(short, long), "lang string, phrase string, n long").groupBy(
        "lang", "phrase").agg(F.sum("n").alias("n"))
    return stored(counted.filter((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, keep_percent: int = KEEP_PERCENT, top: int = TOP,
                 trigger: int = TRIGGER, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of each language.

    A phrase has two or three words and a = its count of at least ``least``; l and r are the counts
    of the parts at its weakest cut (ties: the earlier one), n the words of the
    language, and score = floor(1000000 a a / (l r)).  A phrase in a longer one that has
    ``keep_percent`` in 100 of its count goes.  A null text is empty, a null language ``und``;
    repeated rows count as often as they occur.  Other columns, doc_id too, are
    ignored; an empty table gives no rows.  Scores need a * a * 1000000 below 10**38.
    """
    counts = phrase_counts(docs, least, trigger, most_bits)
    three = F.expr("length(phrase) - length(replace(phrase, ' ', '')) = 2")
    totals = counts.filter("phrase = ''").select("lang", F.col("n").alias("total"))
    often = counts.filter("phrase != ''")  # parts of a candidate are as frequent as itself
    found = often.filter(F.contains("phrase", F.lit(" "))).withColumnRenamed("n", "a")

    def part(count: int) -> Column:
        """That many of the first or (negative) last words."""
        return F.substring_index("phrase", " ", count)

    cuts = found.select("lang", "phrase", "a", F.lit(1).alias("cut"), part(1).alias("left"),
                        F.when(three, part(-2)).otherwise(part(-1)).alias("right")).union(
        found.filter(three).select("lang", "phrase", "a", F.lit(2), part(2), part(-1)))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = heavy_join(stored(cuts, "cuts"), often.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)),
                          ["lang", side], "inner")
    whole = {c: f"cast({c} as decimal(38,0))" for c in ("a", "l", "r")}
    scored = cuts.withColumn("score", F.expr(f"({whole['a']} * {whole['a']} * 1000000) div ({whole['l']} * {whole['r']})"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("w")).select(
        "lang", "phrase", "w.a", "w.l", "w.r", "w.score")
    longer = found.filter(three)
    inside = longer.select("lang", part(2).alias("phrase"), "a").union(
        longer.select("lang", part(-2), "a")).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter(
        F.coalesce(F.lit(100) * F.col("longest") < F.lit(keep_percent) * F.col("a"), F.lit(True)))
    ranked = kept.withColumn("rank", F.expr(
        "row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long")).filter(
        F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark, folder: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{folder}/documents.parquet"))


OP12_SQL = f"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
g as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k from
       (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w cross join (select unnest([1, 2, 3]) as k))),
f as (select lang, phrase, k, count(*) as n from g group by all),
c as (select lang, phrase, string_split(phrase, ' ') as w, k, n as a from f where k > 1 and n >= {LEAST}),
cuts as (select c.*, cut, array_to_string(w[1:cut], ' ') as p1, array_to_string(w[cut + 1:], ' ') as p2
         from c cross join (select unnest([1, 2]) as cut) where cut < k),
s as (select cuts.lang, cuts.phrase, cuts.k, a, cut, x.n as l, y.n as r, ((a::hugeint * a * 1000000) // (x.n::hugeint * y.n))::bigint as score
      from cuts join f x on x.lang = cuts.lang and x.phrase = p1 join f y on y.lang = cuts.lang and y.phrase = p2),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (select lang, phrase, max(a) as longest from (
       select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from c where k = 3) group by all),
kept as (select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase
         where longest is null or 100 * longest < {KEEP_PERCENT} * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, total as n, score from ranked
join (select lang, sum(n)::bigint as total from f where k = 1 group by lang) t using (lang) where rank <= {TOP}
"""
