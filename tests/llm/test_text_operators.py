"""Operators that work row by row: token counts, SentencePiece, chat, decontamination."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import Tokenizer

from featpipe.llm import chat, decontaminate, pieces, tokencount

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def compiled():
    return tokencount.Compiled(BPE)


def _strings(parts, n, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choices(parts, k=r.randint(0, longest))) for _ in range(n)]


def test_token_counts_equal_the_library(compiled):
    parts = [*"abcsrvtlemd'  \n\t!?.,09é漢　½Ⅷ\x1c\x85\xa0", "'re", "'ll", "  ", " '", "<|endoftext|>", "<|endof", "𝒜", "á", "\0"]
    texts = _strings(parts, 4000, 50, 1) + ["a" * 5000, " " * 3000, "'r", "''r", "x'", "é" * 999 + "abc'd" * 300, None, ""]
    library = Tokenizer.from_file(BPE)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokencount.count(compiled, texts).tolist() == want


def test_cuts_do_not_depend_on_the_chunks(compiled):
    text = "".join(_strings([*"ab'srvle  \n1!é"], 50, 80, 2))
    classes = compiled.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    whole = tokencount.run_chunks(classes, compiled.go, compiled.mark, len(text) + 1)
    for size in (1, 2, 3, 7, 64):
        assert (tokencount.run_chunks(classes, compiled.go, compiled.mark, size) == whole).all()


def test_token_counts_of_odd_tables(odd_docs, empty_docs):
    got = tokencount.count_tokens(odd_docs(), BPE)
    assert got.count() == 8 and got.columns.count("n_tokens") == 1
    n = {r.doc_id: r.n_tokens for r in got.collect()}
    assert n[1] == n[2] == 0 and n[6] == len(Tokenizer.from_file(BPE).encode("long " * 60_000).ids)
    assert tokencount.count_tokens(empty_docs, BPE).count() == 0


def _with_normaliser(rule, flags):
    m, own = proto.ModelProto(), proto.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    m.normalizer_spec.CopyFrom(own.normalizer_spec)
    n = m.normalizer_spec
    n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = flags
    return m.SerializeToString()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("flags", [(True, True, True), (True, False, True), (False, True, True), (False, False, False)])
def test_character_map_equals_the_library(rule, flags):
    raw = _with_normaliser(rule, flags)
    mine, library = pieces.Encoder(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in _strings([*"aBc  \t!é漢▁Ⅷ", "ﬁ", "①", "Å", "ＡＢ", "ｶﾞ", "𝒜", "</s>"], 400, 30, 3):
        data, align = mine.normalise(t.encode())
        assert data.decode() == library.normalize(t)
        ids, offsets = mine.encode(t)
        assert ids.tolist() == library.encode(t) and len(offsets) == len(ids) + 1
        assert (np.diff(align) >= 0).all() and (align <= len(t.encode())).all()


def test_pieces_spans_cover_the_text_and_decoding_gives_it_back():
    with open(MODEL, "rb") as f:
        e = pieces.Encoder(f.read())
    for t in _strings([*"abcde  \n!é漢▁", "the ", "𝒜", "<s>", "<0x41>"], 500, 40, 4):
        ids, offsets = e.encode(t)
        raw = t.encode()
        spans = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert b"".join(spans) == raw
        assert ids.tolist() == e.library.encode(t)
        for i, s in zip(ids.tolist(), spans, strict=True):
            if not e.library.is_byte(i) and i != e.unknown:
                surface = e.library.id_to_piece(i).replace("▁", " ")
                assert s.replace("▁".encode(), b" ").decode() in (surface, surface[1:])  # the first blank is not in the text
        if "▁" not in t:
            assert e.decode(ids) == t


def test_sentencepiece_of_odd_tables(odd_docs, empty_docs):
    rows = {r.doc_id: r for r in pieces.encode(odd_docs(), MODEL).collect()}
    assert rows[1].ids == rows[2].ids == [] and rows[1].offsets == [0] and rows[1].decoded == ""
    assert rows[6].decoded == "long " * 60_000
    d = {r.doc_id: r for r in pieces.digests(pieces.encode(odd_docs(), MODEL)).collect()}
    ids = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode("same text here")
    assert d[4].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and d[4].n_tokens == len(ids)
    assert pieces.encode(empty_docs, MODEL).count() == 0


# ---------------------------------------------------------------- chat

def test_chat_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\[b\\\\<", "", None, "[<\\" * 50, "plain\nlines"]
    rows = [(c, t, ["user", "assistant", None, "[x]"][t % 4], texts[(c + t) % 6], "extra") for c in range(5) for t in range(7)]
    rows += [(None, None, "assistant", "x", ""), (None, 1, "user", "y", ""), (9, 0, "user", "only", ""), (9, 0, "user", "only", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    f = chat.format_conversations(df)
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in f.selectExpr("conv_id", "array_join(segments, '') AS s").select(
        "conv_id", chat.read_turns(F.col("s")).alias("t")).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want


def test_every_reply_is_an_example_with_all_turns_before_it(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"say [{t}]") for t in range(300)]  # longer than a run of turns
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ex = chat.expand_targets(f)
    whole = sorted(chat.render(ex, f).collect(), key=lambda r: r.example)
    text = f.selectExpr("array_join(segments, '') AS s").first().s
    assert len(whole) == 150
    for i, r in enumerate(whole):
        assert text.startswith(r.text) and r.text.endswith("</s>")
        assert r.text[r.loss_start : r.loss_start + r.loss_chars] == f"say [\\{2 * i + 1}]"
        assert r.text.count("[INST]") == 2 * i + 2
    assert chat.masked(ex, f).first().loss_text == "".join(f"say [{t}]" for t in range(1, 300, 2))


def test_losses_read_at_the_offsets_of_rendered_examples(spark):
    said = ["grüß [dich]", "", "</s>[INST] ok [/INST]", "日本語 \\ <x>", None]
    rows = [(c, t, "assistant" if (t + (c or 0)) % 3 else "user", said[(t * 7 + (c or 0)) % 5]) for c in (1, 2, None) for t in range(200)]
    rows += [(3, 0, "user", "no reply")]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ex = chat.expand_targets(f, run=16)
    whole = chat.render(ex, f).collect()
    at = {(r.conv_id, r.example): r for r in ex.collect()}
    loss, context = {}, {}
    for r in sorted(whole, key=lambda r: r.example):
        x, turns = at[r.conv_id, r.example], [(role, text or "") for c, _, role, text in rows if c == r.conv_id]
        escaped = r.text[r.loss_start : r.loss_start + r.loss_chars]
        assert r.text.encode()[x.loss_byte : x.loss_byte + x.loss_bytes] == escaped.encode()
        told = spark_free_unescape(escaped)
        ahead = [spark_free_turn(p) for p in r.text[: x.context_chars].split("</s>")[:-1]]
        assert ahead == turns[: x.context_turns] and ("assistant", told) == turns[x.context_turns]  # exactly the turns before
        loss[r.conv_id] = loss.get(r.conv_id, "") + told
        context[r.conv_id] = context.get(r.conv_id, 0) + x.context_chars
    got = {r.conv_id: r for r in chat.masked(ex, f).collect()}
    assert {c: r.loss_text for c, r in got.items()} == loss and {c: r.context_chars for c, r in got.items()} == context
    assert 3 not in got and got[None].n_examples == sum(r[0] is None and r[2] == "assistant" for r in rows)
    # an offset that is wrong by one shows
    assert chat.masked(ex.withColumn("loss_byte", F.col("loss_byte") - 1), f).where("conv_id = 1").first().loss_text != loss[1]


def spark_free_unescape(s):
    return re.sub(r"([\[<\\])\\", r"\1", s)


def spark_free_turn(s):
    role, text = s.removeprefix("[INST] ").split("[/INST]", 1)
    return spark_free_unescape(role), spark_free_unescape(text)


def test_chat_of_an_empty_table(spark):
    f = chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert f.count() == 0 and chat.expand_targets(f).count() == 0


# ---------------------------------------------------------------- decontamination

def _windows(items, n=13):
    out = {}
    for item, text in items:
        w = decontaminate.words_of(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            out.setdefault(tuple(w[i : i + m]), set()).add(item)
    return out


def _brute(text, windows):
    w, hit, items = decontaminate.words_of(text), set(), set()
    for p, own in windows.items():
        for i in range(len(w) - len(p) + 1):
            if tuple(w[i : i + len(p)]) == p:
                hit.update(range(i, i + len(p)))
                items |= own
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_windows_equal_brute_force(spark, prose, odd_docs, block_bytes):
    items = [("10", prose(20, 1)), ("2", prose(13, 2)), ("3", "Three Short words"), ("4", prose(20, 1)), ("5", None), ("6", "!!!"),
             ("7", "solo"), ("8", " ".join(["same"] * 16))]
    texts = [prose(30, 7) + " " + items[0][1].upper() + "," + prose(9, 8), items[1][1], "x three  SHORT-words y", "solo",
             " ".join(["same"] * 40), prose(400, 3) + " " + " ".join(items[0][1].split()[3:18]), prose(50, 9)]
    docs = odd_docs([(100 + i, t, "en", "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = _windows(items)
    got = decontaminate.find_windows(docs, bench, block_bytes=block_bytes)
    assert got.count() == docs.count()
    for r in got.collect():
        if r.doc_id is not None and r.doc_id >= 100:
            assert (r.n_words, r.n_hit, r["items"]) == _brute(texts[r.doc_id - 100], windows), r.doc_id
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    bad = {100 + i for i, t in enumerate(texts) if (b := _brute(t, windows))[1] and 20 * b[1] >= b[0]}
    assert bad and not bad & kept and {1, 2, 3, 4, 5, 6, None} <= kept


def test_blocks_follow_the_size_of_the_tables(spark, prose, odd_docs):
    items = [(str(i), prose(200, i)) for i in range(40)]
    tracemalloc.start()
    decontaminate.Tables(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 40 * 200 * decontaminate.WINDOW_BYTES
    docs = odd_docs([(100 + i, prose(40, 900 + i) + " " + items[i][1] + " " + items[39 - i][1][:300], "en", "s") for i in range(20)])
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole, dealt = (sorted(decontaminate.find_windows(docs, bench, keep_spans=True, table_bytes=n).select(
        "doc_id", "n_words", "n_hit", "items", "spans").collect(), key=str) for n in (1 << 30, 2 << 20))  # one block, four blocks
    assert whole == dealt and sum(r.n_hit > 0 for r in whole) == 20


def test_decontamination_of_empty_tables(spark, empty_docs, odd_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_windows(empty_docs, bench).count() == 0
    assert decontaminate.find_windows(odd_docs(), bench).where("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(odd_docs(), bench).columns == odd_docs().columns
