"""Alignment of tokens against brute force by the libraries, and on odd rows."""

import hashlib
import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries
from tidemark.llm.bpe import byte_letters

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Every group and every link of every document, one after another."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {c: b for b, c in enumerate(byte_letters())}
    vocab = {k: bytes(letters[c] for c in t) for t, k in json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"].items() if all(c in letters for c in t)}
    piece = lambda k: bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()
    docs, holders = [], defaultdict(set)
    for n, (i, text) in enumerate(rows):
        groups = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            whole = (" " + text).encode()
            if b"".join(vocab[x] for x in a) == whole == b"".join(map(piece, b)):
                ends = lambda ids, of: [sum(len(of(x)) for x in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 300 else _running(ids, of)
                ea, eb = ends(a, vocab.__getitem__), ends(b, piece)
                x = y = 0
                for e in sorted(set(ea) & set(eb)):
                    p, q = ea.index(e) + 1, eb.index(e) + 1
                    groups.append((a[x:p], b[y:q]))
                    x, y = p, q
        docs.append((i, groups))
        for ga, gb in groups:
            for s in ga:
                for t in gb:
                    holders[s, t].add(n)
    best = Counter()
    for (s, _), held in holders.items():
        best[s] = max(best[s], len(held))
    out = []
    for i, groups in docs:
        links = [(s, t) for ga, gb in groups for s in ga for t in gb]
        said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        counts = [len(holders[p]) for p in links]
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(c == best[s] for c, (s, _) in zip(counts, links)), sum(counts), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def _running(ids, of):
    out, n = [], 0
    for x in ids:
        n += len(of(x))
        out.append(n)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(queries.QUERIES["op11_alignment"](spark, SF)) == plain(docs)


ODD = [(None, "no id"), (1, None), (2, ""), (3, " "), (4, "<|endoftext|> and </s> <s>"), (5, "a▁b"), (6, "日本語 テキスト 🙂🙂"), (7, "tab\tand\nline\r\n  two  spaces   "), (8, "same text"), (8, "same text"), (9, "same text here"),
       (10, "x" * 3000), (11, "ab cd " * 5000), (12, "ᲉꟋ ࡰ new letters"), (13, "ﬁ ligature ① Ｆull"), (14, "<0x41> é"), (15, "🙂" * 700), (16, "\x00\x01 control")]


@pytest.mark.parametrize("bound", [300_000, 3])
def test_odd_rows(spark, monkeypatch, bound):
    """bound: few groups are broadcast, few links counted at a time, so that all ways are gone."""
    monkeypatch.setattr(alignment, "HEAD", bound)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", bound)
    monkeypatch.setattr(alignment, "LINKS", bound * 8)
    df = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in ODD], "doc_id long, text string, name string, row int, names string").repartition(3)
    got = rows(alignment.align(df))
    assert got == plain(ODD)
    assert sum(r[1] == 0 for r in got) >= 3  # null, empty, and a text with the mark that stands for spaces
    assert alignment.align(df.limit(0)).count() == 0


def test_groups_of_many_equal_tokens():
    assert alignment.links_of("7,7,8|5,5") == [(7, 5, 4), (8, 5, 2)]


def test_the_fast_encoder_is_the_library():
    """On every settled character, alone, repeated and between others."""
    tokens = alignment.Tokens(*map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
    settled = [chr(c) for c in [*range(0x530), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0), *range(0x3040, 0x3100), *range(0x4E00, 0x9FA6, 7), *range(0xAC00, 0xD7A4, 11)]]
    assert not any(tokens.unsettled.search(c) for c in settled) and tokens.unsettled.search("\u0530") and tokens.unsettled.search("🙂")
    texts = [f"a{c} {c}{c}b {c} 1{c}\n{c}  {c}'s {c}." for c in settled]
    assert [tokens.fast.encode_ordinary(t) for t in texts] == [e.ids for e in tokens.exact.encode_batch(texts, add_special_tokens=False)]
