"""Token counts, id store and packing against the tokenizer's library and against each other."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from costweave.llm import id_store, packing, prefix_counts
from costweave.llm.shared import chunks
from costweave.llm.tokens import ChunkEncoder
from costweave.sources.scratch import scratch_path

PARTS = ["a", "b", "The", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'ll", "'", "1", "22", "é", "ß", "\xa0", "\x1c",
         "<|endoftext|>", "<|end", "!", "日本", "_", "-", "😀", "\r\n", " \n", "\n ", "aaaa", "hello", " world"]


@pytest.fixture(scope="module")
def library(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_chunks_join_to_the_text():
    for text in odd_texts(2000, 1):
        assert " ".join(chunks(text)) == text


def test_ids_equal_the_library(tokenizer_path, library):
    texts = odd_texts(3000, 2)
    for text, raw in zip(texts, ChunkEncoder(tokenizer_path).encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(library, text)


def test_every_prefix_has_its_count(tokenizer_path, library):
    texts = odd_texts(300, 3)
    for text, (n, steps) in zip(texts, prefix_counts.PrefixCounter(tokenizer_path).count(texts)):
        assert n == len(ids_of(library, text))
        for k in range(len(text) + 1):
            size = len(text[:k].encode())
            assert prefix_counts.tokens_before(steps, size) == len(ids_of(library, text[:k])), (text, k)
        fits = prefix_counts.longest_within(steps, 3)
        assert fits == max((len(text[:k].encode()) for k in range(len(text) + 1)
                            if len(ids_of(library, text[:k])) <= 3), default=0) or fits > len(text.encode()[:fits].decode(errors="ignore").encode())


def test_counts_of_odd_documents(odd_docs, no_docs, tokenizer_path, library):
    rows = prefix_counts.prefix_counts(odd_docs, tokenizer_path, 512, keep_steps=True).collect()
    expected = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(ids_of(library, r.text)))
                      for r in odd_docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(len(r.steps) == r.n_bytes for r in rows)
    assert prefix_counts.prefix_counts(no_docs, tokenizer_path, 512).count() == 0


def test_store_round_trip(spark, odd_docs, no_docs, tokenizer_path, library):
    root = scratch_path(spark, "store")
    id_store.write_ids(odd_docs, root, tokenizer_path, 2, shard_ids=3_000)
    rows = sorted(id_store.read_ids(spark, root).collect(), key=lambda r: r.start)
    own = [(r.doc_id, ids_of(library, r.text) + [2]) for r in odd_docs.collect()]
    assert [r.doc_id for r in rows] == sorted((k for k, _ in own), key=lambda k: (k is not None, k))
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda x: (x[0] is not None, *x)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=lambda x: (x[0] or -1, *x[1:])) == sorted(
        ((k, len(i), crc(i)) for k, i in own), key=lambda x: (x[0] or -1, *x[1:]))
    asked = spark.createDataFrame([(3,), (7,), (7,), (10_000,), (None,)], "doc_id long")
    found = sorted((r.doc_id, r.ids) for r in id_store.lookup(asked, root).collect())
    assert found == sorted((k, i) for k, i in own if k in (3, 7))
    empty = scratch_path(spark, "store")
    id_store.write_ids(no_docs, empty, tokenizer_path, 2)
    assert spark.read.parquet(f"{empty}/manifest").count() == 0


def test_perfect_hash_is_minimal_and_refuses_others():
    keys = np.unique(np.random.default_rng(0).integers(-2**62, 2**62, 5000))
    index = id_store.PerfectHash.of(keys)
    assert sorted(index.slot(keys).tolist()) == list(range(len(keys)))
    shard = id_store.Shard(id_store.shard_bytes(keys.tolist(), [np.array([k % 7, 2]) for k in keys], 2))
    assert all(shard.get(int(k))[0][0] == k % 7 for k in keys[:200])
    assert all(shard.get(int(k)) == [] for k in keys[:500] + 1 if k not in set(keys.tolist()))


def check_packing(rows, own, window=2048):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, ids in own.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / total


def test_packing_of_the_sample(docs, no_docs, tokenizer_path, library):
    own = {r.doc_id: ids_of(library, r.text) + [1] for r in docs.collect()}
    rows = packing.pack(docs, tokenizer_path, 1).collect()
    assert check_packing(rows, own) < 0.02
    small = packing.Packing(block=5_000)      # many blocks in a task
    assert check_packing(packing.pack(docs, tokenizer_path, 1, small).collect(), own) < 0.05
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)
    assert packing.pack(no_docs, tokenizer_path, 1).count() == 0


def test_packing_of_odd_documents(odd_docs, tokenizer_path, library):
    rows = packing.pack(odd_docs, tokenizer_path, 1).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(library, r.text)) + 1 for r in odd_docs.collect())
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    for _ in range(200):
        at = np.array([0, *sorted(rng.sample(range(1, 60), 12))])
        while (np.diff(at) > 16).any():
            at = np.array([0, *sorted(rng.sample(range(1, 60), 12))])
        cost = np.array([rng.choice([0, 2, 12]) for _ in at])
        best = [0.0] + [1e9] * 12
        for j in range(1, 13):
            best[j] = min(best[i] + 16 - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= 16)
        cuts = [0, *packing.best_cuts(at, cost, 16)]
        assert all(at[b] - at[a] <= 16 for a, b in zip(cuts, cuts[1:])) and cuts[-1] == 12
        assert sum(16 - (at[b] - at[a]) + cost[b] for a, b in zip(cuts, cuts[1:])) == best[12]


def test_prefixes_of_a_text_with_a_word_on_each_line_take_linear_work(tokenizer_path, library):
    own = prefix_counts.PrefixCounter(tokenizer_path)
    text = "\n".join(f"word{i % 977}" for i in range(15_000))
    (n, steps), = own.count([text])
    assert n == len(library.encode(text, add_special_tokens=False).ids) and len(steps) == len(text)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "\t", "　", "\x1c", "\x85", "\r\n", "'s", "'re", "'r", "'l", "'", "''", "!", "!!", "<|",
            "<|endo", "<|endoftext|>", "a", "Hello", "é", "日本", "12", "re", "s", "_", " '", " <"]
    for _ in range(300):
        text = "".join(rng.choices(bits, k=rng.randint(1, 14)))
        (n, steps), = own.count([text])
        assert [prefix_counts.tokens_before(steps, len(text[:k].encode())) for k in range(len(text) + 1)] == [
            len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text


def test_chunks_encoded_as_one_text_have_the_ids_of_each(tokenizer_path, library):
    rng = random.Random(5)
    signs = "abcdeéß日😀'.,-_1234<|Ġ​́"
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    words += ["<|endoftext|>", "a<|endoftext|>b", "'s", "'ll", "\x00", "\x1f", "x\xa0y", "a b", "Ġ", "ĠĠ"]
    code = ChunkEncoder(tokenizer_path)
    into = {}
    left = code._learn_joined(words, into)
    assert set(left) | into.keys() == set(words) and len(left) < 100
    for word, raw in into.items():
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(library, " " + word), word
    text = " ".join(words)
    assert np.frombuffer(code.encode([text])[0], "<u4").tolist() == ids_of(library, text)


def test_a_spoilt_index_is_noticed(spark):
    keys = [None, 3, 5, 5, 9]
    data = bytearray(id_store.shard_bytes(keys, [np.arange(i) for i in range(5)], 2))
    got, record = id_store.Shard(bytes(data)).reached()
    assert got == keys and record.tolist() == [0, 1, 2, 3, 4]
    assert id_store.Shard(id_store.shard_bytes([], [], 2)).reached()[0] == []
    assert id_store.Shard(id_store.shard_bytes([None], [np.arange(2)], 2)).reached()[0] == [None]
    places = id_store.Shard(bytes(data)).footer["places"]
    for section in (4, 5, 6):          # bits of the hash, fingerprints, records
        spoilt = bytearray(data)
        spoilt[places[section]] ^= 1
        with pytest.raises((ValueError, IndexError)):
            id_store.Shard(bytes(spoilt)).reached()


def test_words_around_line_ends_are_learned_from_their_parts(tokenizer_path):
    words = ["alpha.", "Beta", "gamma!!", "it's", "ñandú", "x" * 60, "<|endoftext|>", "1,5", "'s", "日本"]
    texts = [f"start {a}\n{b} {b}\n{a}\n{c} {a}\n\n{b} {c}\r\n{a} {b}\n　{a} end\n" for a in words for b in words for c in words]
    plain = Tokenizer.from_file(tokenizer_path)
    own, sent = ChunkEncoder(tokenizer_path), []
    library = own.tokenizer

    class Counted:
        def encode_batch_fast(self, part, **settings):
            sent.extend(part)
            return library.encode_batch_fast(part, **settings)

    own.tokenizer = Counted()
    for part in (texts[:300], texts[300:]):
        for text, ids in zip(part, own.encode(part)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    sent.clear()
    own.encode([f"go {a}\n{b}" for a in words[:4] for b in words[:4]])      # met beside each other, but not after "go"
    own.encode([f"go {a}\n{b}\n{c}\n{a}" for a in words[:4] for b in words[:4] for c in words[:4]])
    assert "go" in sent and not any("\n" in text for text in sent)


def test_table_of_numbers():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5000):
        keys = np.unique(np.r_[rng.integers(0, 1 << 40, n), np.arange(n)])
        table, asked = prefix_counts.Table(keys, np.arange(len(keys))), np.r_[keys, rng.integers(0, 1 << 40, 2000)]
        at = dict(zip(keys.tolist(), range(len(keys))))
        assert table[asked].tolist() == [at.get(k, -1) for k in asked.tolist()]


SIGNED = ["word." * 3, "a.\nb!, c? d", "x's. it's\nfoo.'s a'. a.'", "end.\n", "\nend.", "a\n\nb.", " .a a. .b", "a.<|endoftext|> b<| c|>",
          "×a ÷. ª. µ. ºx ʯ. ʰ. ǅ. ƻ!", "b\x1c. c\x85d.", "a.\tb a.\r\nb.", "a" * 60 + ". " + "b" + "." * 60, "a1. 1a. a_b_ _c"]


def test_words_and_the_signs_after_them_give_the_librarys_ids(tokenizer_path, library):
    code, counts = ChunkEncoder(tokenizer_path), prefix_counts.PrefixCounter(tokenizer_path)
    texts = [f"start {t} middle {t}" for t in SIGNED] + SIGNED
    for _ in range(2):
        ids = [ids_of(library, t) for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in code.encode(texts)] == ids
    for t, (n, steps) in zip(texts, counts.count(texts)):
        assert n == len(ids_of(library, t))
        if t.isascii() and "<|" not in t:
            assert np.cumsum(np.frombuffer(steps, np.int8)).tolist() == [
                len(ids_of(library, t[:i])) for i in range(1, len(t) + 1)]


def test_a_word_is_encoded_once_whatever_signs_follow_it(tokenizer_path, monkeypatch):
    code = ChunkEncoder(tokenizer_path)
    met: list[str] = []
    learn = code._learn_after
    monkeypatch.setattr(code, "_learn_after", lambda need, *rest: met.extend(need) or learn(need, *rest))
    code.encode(["x " + " ".join("word" + a + b for a in ".,;!?" for b in ["", ".", "\nnext."])])
    assert sorted(met) == ["next", "word"]


def test_signs_after_words_need_no_look_at_their_parts(tokenizer_path):
    counts = prefix_counts.PrefixCounter(tokenizer_path)
    assert counts._words(" ", "end.\nNext,") == [" end", ".", "\n", "Next", ","]
    assert counts._words("", "end") == ["end"]
    for odd in ("it's.", "a\n\nb", "a\n", "a.\tb", "a1.", ""):
        assert counts._words(" ", odd) is None
