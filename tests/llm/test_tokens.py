import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from nearlabel.llm import packing, pieces, queries, rans, token_counts
from nearlabel.llm.pieces import PieceEncoder, vocabulary

ODD = ["", None, " ", "  a", "a  b", "a \n b", "<|endoftext|> x <|endoftext|>", "a<|endoftext|>", "ΑΣ ΑΣΑ Σ.", "é x", "it's  don't 'S", "a ́b", "İstanbul ǅ", "x\x1c y \x85 z", "日本 語", "👍🏽 ok 👍", "word " * 5000, "x" * 30000]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("batch", [None, 7])
def test_pieces_equal_library(name, batch, monkeypatch):
    if batch:
        monkeypatch.setattr(pieces, "BATCH_BYTES", batch)
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "a", "B", "'s", "<|endoftext|>", "é", "́", "1", "..", "\t", " ", "Σ", "x y", "ſ"]
    texts = ODD[: 12 if batch else None] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    enc, tok = PieceEncoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    flat, counts = enc.ids(texts)
    assert counts.tolist() == [len(w) for w in want] == enc.counts(texts).tolist()
    assert flat.tolist() == [i for w in want for i in w]


def test_token_counts_rows(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(0, "", "clash")], SCHEMA)
    got = token_counts.token_counts(df, vocabulary("byte_bpe_50k.json")).collect()
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (i, len((t or "").encode()), n := len(tok.encode(t or "").ids), n > 512) for i, t in [*enumerate(ODD), (0, "")]
    )
    assert token_counts.token_counts(df.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op9_whole_table(spark, sf):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, sf).collect()}
    assert got == {k: len(tok.encode(t).ids) for k, t in texts.items()}


def test_op2_round_trip(spark, sf):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, start = {}, 0
    for k, t in docs:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_rans(spark, sf).collect()} == want


def test_rans_long_documents_and_odd_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rans, "BLOCK", 1 << 10)
    monkeypatch.setattr(rans, "SLICE", 100)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(3, "again", "x"), (None, "none", "x")], SCHEMA).coalesce(1)
    rans.write_ids(df, vocabulary("byte_bpe_50k.json"), f"{tmp_path}/f")
    rows = rans.read_ids(spark, f"{tmp_path}/f").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([None, 3, *range(len(ODD))], key=lambda k: -1 if k is None else k)
    at = 0
    for r in rows:
        assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
        at += r.n_tokens
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    long = next(r for r in rows if r.doc_id == 16)
    assert np.frombuffer(long.ids, "<u4").tolist() == tok.encode(ODD[16]).ids + [2]
    rans.write_ids(df.limit(0), vocabulary("byte_bpe_50k.json"), f"{tmp_path}/e")
    assert rans.read_ids(spark, f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 131072, 300001])
def test_rans_block(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=5000).astype(np.uint16)
    used, counts = np.unique(ids, return_counts=True)
    table = rans.Table(used.astype(np.int64), rans.scaled(counts))
    payload = rans.encode_block(ids, table)
    assert (rans.decode_block(payload, table) == ids).all()
    last = rans.segments(payload) - 1
    assert (rans.decode_segment(payload, table, last) == ids[last * rans.STEPS * rans.LANES :]).all()
    cut = [rans.cut_segment(payload, k) for k in range(last + 1)]
    assert (np.concatenate([rans.decode_block(c, table) for c in cut]) == ids).all() and (last == 0 or max(map(len, cut)) < len(payload))
    broken = bytearray(payload)
    broken[len(payload) * 3 // 4] ^= 1
    if n > 9000:
        with pytest.raises(ValueError):
            rans.decode_block(bytes(broken), table)


def test_op1_packs_every_id_once(spark, sf):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_packing(spark, sf).collect()
    seqs, docs = {}, {}
    for r in rows:
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        assert r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
    for rows in [*seqs.values(), *docs.values()]:
        at = 0
        for start, n in sorted(rows):
            assert start == at
            at += n
    assert {k: sum(n for _, n in v) for k, v in docs.items()} == {k: len(v) for k, v in want.items()}
    sizes = [sum(n for _, n in v) for v in seqs.values()]
    assert max(sizes) <= 4096
    assert sum(4096 - s for s in sizes if s & (s - 1)) < 0.01 * sum(sizes)


def test_vector_limits():
    rnd = np.random.default_rng(5)
    demand = np.stack([rnd.integers(1, 900, 700), np.ones(700, int), rnd.integers(0, 500, 700)], axis=1)
    demand[:, 2] = np.minimum(demand[:, 2], demand[:, 0])
    capacity = np.array([1000, 4, 600])
    bins = packing.pack(demand, capacity)
    for b in range(bins.max() + 1):
        assert (demand[bins == b].sum(axis=0) <= capacity).all() and (bins == b).any()
    bound = (demand.sum(axis=0) / capacity).max()
    assert bins.max() + 1 < 1.35 * bound


@pytest.mark.parametrize("binds", ["tokens", "segments", "loss"])
def test_each_limit_decides(spark, binds):
    """Instruction data with prompts: every limit holds in every sequence, and the tight one is reached in most."""
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rnd = random.Random(2)
    rows = [(i, p := " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30))), p + " " + " ".join(rnd.choice("mnopqrs") for _ in range(rnd.randint(1, 40)))) for i in range(400)]
    rows += [(1000, "x " * 700, "x " * 700 + "y " * 900), (1001, None, "z " * 1000)]
    limits = {"tokens": packing.Limits(256, 64, 256), "segments": packing.Limits(1024, 5, 1024), "loss": packing.Limits(512, 64, 100)}[binds]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(1)
    got = packing.pack_documents(df, vocabulary("word_bpe_49k.json"), limits=limits, prompt="prompt").collect()
    bare = {i: max(1, len(tok.encode(p or "", add_special_tokens=False).ids)) for i, p, _ in rows}
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, _, t in rows}
    seqs, docs = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id][r.start : r.start + r.length] and r.loss_tokens == sum(r.start + j >= bare[r.doc_id] for j in range(r.length))
        seqs.setdefault(r.sequence_id, []).append((r.length, 1, r.loss_tokens))
        docs[r.doc_id] = docs.get(r.doc_id, 0) + r.length
    assert docs == {i: len(w) for i, w in want.items()}
    sums = np.array([np.sum(s, axis=0) for s in seqs.values()])
    assert (sums <= [limits.tokens, limits.segments, limits.loss]).all()
    full = sums / [limits.tokens, limits.segments, limits.loss] >= 0.95
    assert full[:, ["tokens", "segments", "loss"].index(binds)].mean() > 0.6


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(3, "a  b", "x"), (None, "none", "x")], SCHEMA)
    df = df.withColumns({c: df.n_tokens for c in ("start", "length", "bare", "prompt", "ids", "sequence_id")})
    rows = packing.pack_documents(df, vocabulary("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in rows} == {None, *range(len(ODD))} and all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_dialogues_reach_every_limit(spark):
    """The whole table's answers with their questions as prompts: exact ids, no limit broken, segments and loss both bind."""
    sf = "/root/testdata/sf0.01"
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    said = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    want, bare = {}, {}
    for (c, t), r in said.items():
        if r.role == "assistant":
            before = said.get((c, t - 1))
            prompt = (before.text or "") + "\n" if before is not None and before.role != "assistant" else ""
            want[c << 20 | t] = [*tok.encode(prompt + (r.text or ""), add_special_tokens=False).ids, 2]
            bare[c << 20 | t] = max(1, len(tok.encode(prompt, add_special_tokens=False).ids))
    rows = queries.pack_dialogues(spark, sf).collect()
    seqs, docs = {}, {}
    for r in rows:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(ids) and r.loss_tokens == sum(r.start + j >= bare[r.doc_id] for j in range(r.length))
        seqs.setdefault(r.sequence_id, []).append((r.length, 1, r.loss_tokens))
        docs[r.doc_id] = docs.get(r.doc_id, 0) + r.length
    assert docs == {i: len(w) for i, w in want.items()}
    sums = np.array([np.sum(s, axis=0) for s in seqs.values()])
    limits = queries.DIALOGUES
    assert (sums <= [limits.tokens, limits.segments, limits.loss]).all()
    print(len(sums), (sums == limits.segments).sum(axis=0), (sums / [limits.tokens, limits.segments, limits.loss]).mean(axis=0))
    assert (sums[:, 1] == limits.segments).any() and (sums[:, 2] >= 0.95 * limits.loss).any()


def test_ranges_are_read_by_segment(spark, tmp_path):
    """Any range of the corpus' ids, from the segments that hold it and no others."""
    rnd = random.Random(5)
    df = spark.createDataFrame([(k, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.choice([3, 60000])))) for k in range(12)], "doc_id long, text string")
    rans.write_ids(df, vocabulary("byte_bpe_50k.json"), f"{tmp_path}/r")
    whole = b"".join(bytes(r.ids) for r in rans.read_ids(spark, f"{tmp_path}/r").orderBy("start").collect())
    n, span = len(whole) // 4, rans.STEPS * rans.LANES
    assert n > 2 * span
    for first, last in ((0, n), (0, 1), (n - 1, n), (span - 1, span + 1), (n // 2, n // 2 + 7), (5, 5), (n, n + 9)):
        rows = rans.read_range(spark, f"{tmp_path}/r", first, last).orderBy("start").collect()
        assert all(bytes(r.ids) == whole[4 * r.start : 4 * r.start + len(r.ids)] and r.start < last and r.start + len(r.ids) // 4 > first for r in rows)
        held = sum(min(last, r.start + len(r.ids) // 4) - max(first, r.start) for r in rows)
        assert held == max(0, min(last, n) - first)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_letters_are_not_searched(name):
    """Only pieces with other characters go through the pattern; ids are the library's, across batches and kinds of pieces."""
    enc = pieces.PieceEncoder(pieces.vocabulary(name))
    texts = ["The House naïve straße ÷ x×y don't end.", "the house Ünder é a1   b 　 c  d", None, "plain words alone", "日本 <|endoftext|> x"]
    tok, searched, find = enc.tok, [], enc.find
    enc.find = lambda text: searched.append(text) or find(text)
    for _ in range(2):
        flat, n = enc.ids(texts)
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert not any(w in text for text in searched for w in (" words", " alone", " house"))


def test_encoders_go_when_other_operators_begin():
    """A worker that hashes sets or counts terms holds no tokenizer and memo of an earlier task."""
    from nearlabel.llm import KEPT, fragment_join, pieces, toxicity

    path, batch = pieces.vocabulary("word_bpe_49k.json"), pa.record_batch({"text": ["a b"]})
    for other in (lambda: toxicity.words_of(["a b"]), lambda: list(fragment_join._slices(iter([batch])))):
        enc = pieces.encoder(path)
        assert pieces.encoder(path) is enc and path in KEPT
        other()
        assert not KEPT
