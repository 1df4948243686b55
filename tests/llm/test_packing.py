import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from cloakframe.llm.packing import _blocks, _Encoder, _unsplit, best_fill, fill_plan, op4_packing, pack, tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def check(rows, texts, tokenizer, window=1024):
    """Every id of every document in exactly one piece, sequences gapless and within the window."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for k, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(docs[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            part = ids[at:at + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(sequences) * window / sum(r.length for r in rows)


def test_whole_table(spark, small, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert check(op4_packing(spark, small).collect(), texts, tokenizer) < 1.02


def test_odd_texts(docs_of, tokenizer):
    texts = {1: None, 2: "", 3: "  \n\n a  b\t\tc   ", 4: "x " * 5000, 5: "<|endoftext|>  <|endoftext|>a",
             6: "\x1c\x1d é  ü \u0085 b", 7: "😀😀 it's 'll 123 4", 8: " "}
    check(pack(docs_of(texts.items()), tokenizer_file()).collect(), texts, tokenizer)
    assert pack(docs_of([]), tokenizer_file()).count() == 0
    assert pack(docs_of([(None, "a"), (None, "a"), (3, "b"), (3, "b")]), tokenizer_file()).count() == 4


def test_encoder_on_random_text(tokenizer):
    rng, encoder = random.Random(1), _Encoder(tokenizer_file())
    signs = "ab1 '  \n\t.!é漢  \x1c\x85<|>endoftext"
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert encoder.ids([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_encoder_without_room(tokenizer):
    """Runs beyond the kept ones, and runs too long to be kept, are encoded each time."""
    rng, encoder = random.Random(3), _Encoder(tokenizer_file(), most=5)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 200]))) for _ in range(30))
             for _ in range(50)]
    for at in range(0, 50, 10):
        assert encoder.ids(texts[at:at + 10]) == [
            np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[at:at + 10]]
    assert len(encoder._known) <= 5 and all(len(r) <= 64 for r in encoder._known)
    assert [len(b) for b in _blocks(["a" * 2_000_001, "b", "c" * 1_999_999, "d", ""])] == [1, 2, 2]
    assert list(_blocks([])) == []


def test_new_parts_are_encoded_as_one_text(tokenizer):
    """One call for a block of words; those that could hold the token between them are encoded by themselves."""
    encoder, calls = _Encoder(tokenizer_file()), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **how)

    encoder._tokenizer = Counted()
    texts = [" ".join(f"word{i}, x{i}.\nend{i}" for i in range(200)), "a\n\n\nb  c \n d\t e\n", "\n a", " \n", "a ", "\n"]
    wanted = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.ids(texts) == wanted and calls == [1]
    assert encoder.ids(texts[:1]) == wanted[:1] and calls == [1]
    assert encoder.ids(texts) == wanted
    texts = ["one <|endoftext|>two", "<|endof text|> three <", "<|endoftext|>"]
    assert encoder.ids(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder._between = None
    assert encoder.ids(["four five"]) == [np.array(tokenizer.encode("four five", add_special_tokens=False).ids, "<u4").tobytes()]


def test_new_parts_follow_each_other(tokenizer):
    """Parts behind blanks are encoded as they would stand in a text, each once, whatever signs are at its end."""
    encoder, sent = _Encoder(tokenizer_file()), []

    class Kept:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return self.of.encode_batch_fast(texts, **how)

    unsplit = encoder._unsplit
    encoder._tokenizer, encoder._unsplit = Kept(tokenizer), Kept(unsplit)
    texts = ["zero alphab betagam###\nDelta alphab&&& alphab. betagam,", "it's's' alphab'' betagam$$$ a1... b2.c!? x<|>"]
    wanted = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.ids(texts) == wanted
    assert sum(x.count("alphab") for x in sent) == sum(x.count("betagam") for x in sent) == 1
    assert not any("<|endoftext|> " in x for x in sent)  # nothing lies in front of a blank but the part before
    sent.clear()
    assert encoder.ids(["zero alphab### betagam&&&"]) == [
        np.array(tokenizer.encode("zero alphab### betagam&&&", add_special_tokens=False).ids, "<u4").tobytes()]
    assert sent == []


def test_words_of_letters_need_no_splitting(tokenizer):
    """The tokens of words some at a time are those of each by itself; not where a token reaches over a border."""
    rng, encoder = random.Random(5), _Encoder(tokenizer_file(), most=0)
    assert encoder._unsplit is not None
    words = ["".join(rng.choice("aeiourstlnABCéßñüÖœž") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = ["".join(rng.choice([" ", " ", "\n"]) + w for w in words[at:at + 500]) for at in range(0, 3000, 500)]
    assert encoder.ids(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    letters = [*pre_tokenizers.ByteLevel.alphabet(), "Ġa"]
    for over in ("aĠ", "Ċa"):
        bpe = models.BPE({x: i for i, x in enumerate([*letters, over])}, [("Ġ", "a"), tuple(over)])
        other = Tokenizer(bpe)
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
        assert _unsplit(other) is None
        other.model = models.BPE({x: i for i, x in enumerate(letters)}, [("Ġ", "a")])
        assert _unsplit(other).encode("a a a").ids == other.encode("a a a").ids
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
        assert _unsplit(other) is None


def test_blocks_of_odd_texts(tokenizer):
    """Texts with blanks behind blanks beside others that share their words, and texts of blanks alone."""
    rng, encoder = random.Random(4), _Encoder(tokenizer_file(), most=200)
    words = ["a", "Bc", "dé", "12", "it's", "x<|endoftext|>y", "<|>", "'", "$$$", "e.f", "ß", "漢", "\x1c", "\xa0", "<|endoftext|>", "'ll"]
    for _ in range(300):
        texts = ["".join(rng.choice(words) + rng.choice(["", "", "###", ".", "?!", "'", ">"]) + rng.choice(blanks)
                         for _ in range(rng.randint(0, 12)))
                 for blanks in ([" "], [" ", "\n"], [" ", "  ", "\n", "\n\n ", "\t", " \t"])
                 for _ in range(3)] + [rng.choice(["\t", " ", "\n", "\t ", "\n\n", "\xa0", " \xa0", "\x1c"])]
        assert encoder.ids(texts) == [
            np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(encoder._known) <= 200 and not encoder._known.new


def test_best_fill_is_closest():
    rng = random.Random(2)
    for _ in range(200):
        counts = np.zeros(31, np.int64)
        for _ in range(rng.randint(1, 6)):
            counts[rng.randint(1, 30)] += rng.randint(1, 4)
        sums = {0}
        longest = int(np.flatnonzero(counts)[-1])
        for length in np.flatnonzero(counts):
            n = int(counts[length]) - (length == longest)
            sums = {s + length * k for s in sums for k in range(n + 1)}
        fill = best_fill(counts, 30)
        assert all(n <= counts[length] for length, n in fill)
        assert sum(length * n for length, n in fill) == max(s for s in sums if s + longest <= 30) + longest


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 1025)
    counts[0] = 0
    plan = fill_plan(counts, 1024)
    for length, rows in plan.groupby("length"):
        assert rows["first"].tolist() == [0, *rows["last"].tolist()[:-1]] and rows["last"].iloc[-1] == counts[length]
