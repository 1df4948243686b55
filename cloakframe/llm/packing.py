"""Packing token sequences by minimum bin slack.

1. Texts become token ids on the executors.  A document fills whole windows; what
   remains (shorter than a window) is one piece.  Every piece has a number within its
   stored part and length, so pieces can be dealt out without sorting them.
2. Only how many pieces of each length there are goes to the driver: at most as many
   numbers as a window has tokens, whatever the size of the input.
3. For one window, a bitset subset-sum over the remaining multiset of lengths finds the
   fill closest to the window, beginning with the longest remaining length; the counts
   of each length are traced back.  The same fill is repeated as often as
   the counts allow, so the plan has at most some fills per length.
4. Pieces of a length take the places of that length in the plan, in order.
"""

from __future__ import annotations

import itertools
import os
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.tables import in_process, keyed_texts, stored

WINDOW = 1024
_RUN = re.compile(r"\s*\S+|\s+")


def best_fill(counts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(length, how many) closest to ``window`` from ``counts[length]``, with the longest length in it."""
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1]]
    first = lengths[0]
    room = window - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left = min(int(counts[length]) - (length == first), room // length)
        power = 1
        while left > 0:
            take = min(power, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            power *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            taken[length] = taken.get(length, 0) + take
    return sorted(taken.items(), reverse=True)


def fill_plan(counts: np.ndarray, window: int) -> pd.DataFrame:
    """length, first, last, each, sequence, offset: where the pieces of a length go.

    Pieces ``first`` to ``last - 1`` of a length lie ``each`` by ``each`` in
    consecutive sequences, from ``offset`` on.
    """
    counts = counts.copy()
    used = np.zeros_like(counts)
    rows, sequence = [], 0
    while counts.any():
        fill = best_fill(counts, window)
        times = min(int(counts[length]) // n for length, n in fill)
        offset = 0
        for length, n in fill:
            rows.append((length, int(used[length]), int(used[length]) + n * times, n, sequence, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += length * n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "last", "each", "sequence", "offset"]).astype(
        "int64").sort_values(["length", "first"], ignore_index=True)


class _Known(dict):
    """Token bytes of parts; each part looked up that is not in it gets one empty place in ``new``, to be filled."""

    def __init__(self):
        super().__init__()
        self.new = defaultdict(bytearray)

    def __missing__(self, part: str) -> bytearray:
        return self.new[part]


class _Encoder:
    """Token bytes of texts, from words with the blank in front of them.

    A byte-level pre-tokenizer never joins characters over the border in front of a blank behind
    something else, nor over that between a letter or number and a sign, so a text has the
    ids of its parts, one after another.  Texts are split at single spaces and line feeds; those with blanks
    behind blanks at such a border are cut into runs instead.  Short parts met before are looked up (at
    most ``most``), all others of a block of texts are encoded together, without the signs at their ends.
    """

    LONGEST = 64  # characters of a part that is kept

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known = _Known()
        self._most = most
        added = self._tokenizer.get_added_tokens_decoder()
        single = [(key, token.content) for key, token in added.items()
                  if token.content.count(token.content[0]) == 1 and not (
                      token.lstrip or token.rstrip or token.single_word or token.normalized)]
        #: Id and text of a token that is cut out of any text before all else, if it is the only one.
        self._between = single[0] if len(single) == len(added) == 1 else None
        #: Signs that no such token holds: a part may be cut in front of those at its end.
        self._signs = "".join(set(string.punctuation).difference(*(token.content for token in added.values())))
        vocabulary = self._tokenizer.get_vocab()
        #: By id, whether a token begins with a space or line feed.
        self._begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self._begins[[key for token, key in vocabulary.items() if token[0] in "ĠĊ"]] = True
        self._unsplit = _unsplit(self._tokenizer) if self._between else None

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """The token bytes of each part; those that cannot hold the token between them are encoded together.

        Parts with a space or line feed in front, and no other, follow each other: words of letters alone some at
        a time, where they need not be split, and other parts as one text.  In it, the token lies between the rest.
        """
        if not self._between:
            return self._one_by_one(parts)
        token, text = self._between
        found: dict[str, bytes] = {}
        words = [part for part in parts if _WORD(part)] if self._unsplit else []
        if words:
            every = self._unsplit.encode_batch_fast(
                ["".join(map(_literal, words[at:at + _WORDS])) for at in range(0, len(words), _WORDS)],
                add_special_tokens=False)
            ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in every), "<u4")
            begins = np.flatnonzero(self._begins[ids])
            if len(begins) == len(words):
                found = _cut(words, ids.tobytes(), [*begins.tolist(), len(ids)])
        plain = [part for part in parts if part not in found and text[0] not in part]
        if plain:
            near = [part for part in plain if part[0] != " "]
            rest = [part for part in plain if part[0] == " "]
            joined = text.join(["".join(map(_literal, near)), *map(_literal, rest)])
            every, = self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)
            ids = np.array(every.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == token), len(ids)).tolist()
            begins = np.flatnonzero(self._begins[ids[:ends[0]]])
            if len(ends) == len(rest) + 1 and len(begins) == len(near):
                ids = ids.tobytes()
                found.update(_cut(near, ids, [*begins.tolist(), ends[0]]))
                found.update(_cut(rest, ids, ends, 4))
        if len(found) < len(parts):
            found.update(self._one_by_one([part for part in parts if part not in found]))
        return found

    def _one_by_one(self, parts: list[str]) -> dict[str, bytes]:
        found = self._tokenizer.encode_batch_fast([*map(_literal, parts)], add_special_tokens=False)
        return {part: np.array(e.ids, "<u4").tobytes() for part, e in zip(parts, found)}

    def ids(self, texts: list[str]) -> list[bytes]:
        known = self._known
        new = known.new
        parts = [_parts(text) for text in texts]
        values = [list(map(known.__getitem__, own)) for own in parts]
        odd = {part for part in new if not part or part[-1].isspace()}
        for part in odd:  # before the runs are looked up, as one of them may be written alike
            del new[part]
        if odd:
            for at, own in enumerate(parts):
                if not odd.isdisjoint(own):
                    values[at] = [known[_part(run)] for run in _RUN.findall(texts[at])]
        signs = self._signs
        stems = {part: stem for part in new if part[-1] in signs and (stem := part.rstrip(signs))[-1:].isalnum()}
        tails = {part: " " + part[len(stem):] for part, stem in stems.items()}
        wanted = [*(new.keys() - stems.keys()).union(x for x in (*stems.values(), *tails.values()) if x not in known)]
        fresh: dict[str, bytes] = {}
        for at in range(0, len(wanted), _ENCODED):
            fresh.update(self._encoded(wanted[at:at + _ENCODED]))
        for part, stem in stems.items():
            tail = tails[part]
            fresh[part] = (known.get(stem) or fresh[stem]) + (known.get(tail) or fresh[tail])
        for part, place in new.items():
            place += fresh[part]
        new.clear()
        for part, value in fresh.items():  # frequent parts come early and stay
            if len(known) >= self._most:
                break
            if len(part) <= self.LONGEST and not part[-1].isspace():  # a blank at the end marks odd texts
                known[part] = value
        return [b"".join(own) for own in values]


def _parts(text: str) -> list[str]:
    """The text split in front of spaces and line feeds.

    A part is written without its space.  One without a space in front is the text behind a space,
    or begins with its line feed.
    """
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = " " + parts[0]
    return parts


def _part(run: str) -> str:
    """The part that stands for a run of blanks and what follows them."""
    if run[0] in " \n" and not run[1:2].isspace() and len(run) > 1:
        return run[1:] if run[0] == " " else run
    return " " + run


def _literal(part: str) -> str:
    """What a part of :func:`_parts` stands for."""
    return part[1:] if part[0] == " " else part if part[0] == "\n" else " " + part


def _cut(parts: list[str], ids: bytes, cuts: list[int], behind: int = 0) -> dict[str, bytes]:
    """The bytes of each part, which lie ``behind`` a cut and before the next one."""
    return {part: ids[4 * x + behind:4 * y] for part, x, y in zip(parts, cuts, cuts[1:])}


#: Letters that any version of Unicode calls letters, of one or two bytes; a part of nothing else.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(f"\n?[{_LETTERS}]+").fullmatch


def _unsplit(tokenizer):
    """The tokenizer without its splitting, if this gives the same tokens for words of letters behind spaces and line feeds.

    It splits in front of both and behind line feeds.  Where no token holds such a border, no merge can reach over it, so
    the splitting changes nothing.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    model, split = tokenizer.model, tokenizer.pre_tokenizer
    if not (isinstance(model, models.BPE) and isinstance(split, pre_tokenizers.ByteLevel)
            and split.use_regex and not split.add_prefix_space and tokenizer.normalizer is None
            and not (model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix
                     or model.byte_fallback or model.ignore_merges)):
        return None
    whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = re.findall(f"[{_LETTERS}]", "".join(map(chr, range(0x250))))
    (spelled, _), = whole.pre_tokenize_str("".join(letters))
    spelled = set(spelled)
    for token in tokenizer.get_vocab():
        if ("Ġ" in token[1:] or "Ċ" in token[1:] or token[0] == "Ċ") and (
                own := set(token) - {"Ġ", "Ċ"}) and own <= spelled:
            return None
    plain = Tokenizer(model)
    plain.pre_tokenizer = whole
    return plain


#: Words that are encoded as one text, new runs that are encoded at once, and characters of texts that are looked up together.
_WORDS = 30
_ENCODED = 2_000
_BLOCK = 2_000_000


def _blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in order, in blocks of about :data:`_BLOCK` characters; a longer text is alone."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > _BLOCK:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


_PIECES = pa.schema([(name, pa.int32() if name == "part" else pa.int64()) for name in (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank")])


def _tokenized(path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_process("tokens", path, lambda: _Encoder(path))
        met = [0] * (window + 1)
        part = None
        for batch in batches:
            part = batch.column("part")[0].as_py() if part is None and batch.num_rows else part
            at = 0
            for block in _blocks(text.as_py() for text in batch.column("text")):
                out = []
                for doc_id, ids in zip(batch.column("doc_id").slice(at, len(block)).to_pylist(), encoder.ids(block)):
                    ids += end
                    tokens = len(ids) // 4
                    for start in range(0, tokens, window):
                        piece = ids[4 * start:4 * (start + window)]
                        length = len(piece) // 4
                        out.append((doc_id, start, length, zlib.crc32(piece), tokens, part, met[length]))
                        met[length] += 1
                at += len(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind) for values, kind in zip(zip(*out), _PIECES.types)], schema=_PIECES)

    return run


def _placed(plan: pd.DataFrame):
    key = plan["length"].to_numpy() << 40 | plan["first"].to_numpy()
    first, each, sequence, offset = (plan[c].to_numpy() for c in ("first", "each", "sequence", "offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            behind = rank - first[at]
            yield batch.drop(columns="rank").assign(
                sequence_id=sequence[at] + behind // each[at],
                offset=offset[at] + behind % each[at] * length)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    ``tokenizer`` is the file of a byte-level tokenizer, in the same place on every
    executor.  Every document is its ids and ``end_id``; a null or empty text is
    ``end_id`` alone.  Repeated rows are packed as often as they occur, also
    without a doc_id; other columns are ignored, and an empty table gives no rows.
    The numbers of sequences have no gaps.
    """
    texts = keyed_texts(docs).withColumn("part", F.spark_partition_id())
    pieces = stored(texts.mapInArrow(
        _tokenized(tokenizer, window, end_id),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long",
    ), "pieces")
    local = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    local = stored(local, "lengths")
    counts = np.zeros(window + 1, np.int64)
    for row in local.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length] = row.n
    before = local.alias("a").withColumn("before", F.expr(
        "sum(n) over (partition by length order by part) - n")).drop("n")
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInPandas(
        _placed(fill_plan(counts, window)),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_file())
