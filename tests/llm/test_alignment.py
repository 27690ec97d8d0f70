"""Token groups, links and counts against plain Python over the libraries' own encoders."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import alignment

BPE, PIECES = f"{alignment.FOLDER}/byte_bpe_50k.json", f"{alignment.FOLDER}/piece_bpe_32k.model"


def letters():
    """Byte-level characters, stated otherwise than in the library."""
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {}, 0
    for b in range(256):
        if b in keep:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES), letters()


def plain(rows, encoders):
    a_of, b_of, alphabet = encoders
    told = []
    for doc_id, text in rows:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        a_bytes = [bytes(alphabet[c] for c in a_of.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            piece = b_of.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            told.append((doc_id, [], [], [], []))
            continue
        ranges = []
        for tokens in (a_bytes, b_bytes):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            ranges.append(out)
        links, j0 = [], 0
        for i, (x, y) in enumerate(ranges[0]):
            while ranges[1][j0][1] <= x:
                j0 += 1
            j = j0
            while j < len(b) and ranges[1][j][0] < y:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({y for _, y in ranges[0]} & {y for _, y in ranges[1]})
        groups = [([], []) for _ in cuts]
        for side, (ids, r) in enumerate(zip((a, b), ranges)):
            at = 0
            for t, (_, y) in zip(ids, r):
                groups[at][side].append(t)
                at += y == cuts[at]
        told.append((doc_id, a, b, groups, links))
    count = Counter(pair for *_, links in told for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, a, b, groups, links in told:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


ODD = ["", None, " ", "  two  spaces ", "a", "\n\n\t x", "<|endoftext|> as text <s>", "▁ mark", "é́ naïve Ünï", "日本語のテキスト、漢字", "😀👩‍👩‍👧 ok", "\x00 nul \x7f", "don't WE'LL I'm 's", "１２３ ½ Ⅷ", "x" * 3000, "﻿bom", " nbsp em", "word " * 4000, "ab" * 60_000]


@pytest.mark.parametrize(("chunk", "fan"), [(alignment.CHUNK_BYTES, alignment.FAN), (300, 2)])
def test_alignment_against_plain_python(spark, monkeypatch, encoders, chunk, fan):
    """Small chunks are summed in several turns and ask in several places."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "FAN", fan)
    monkeypatch.setattr(alignment, "BATCH", 7)
    rng = random.Random(4)
    words = ["the", "and", "Tokenizer", "überall", "naïve", "x1", "12,000", "—", "日本", "zzqx", "don't", "\n", "  "]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80))), "x", 1) for i in range(80)]
    rows += [(100 + i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, rows[3][1], "again", 2), (3, rows[3][1], "again", 2), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, pairs string, n_a int").repartition(3)
    found = sorted((tuple(r) for r in alignment.align(docs).collect()), key=str)
    assert found == plain([r[:2] for r in rows], encoders)


def test_encoders_agree_with_the_vocabulary_files(encoders):
    with open(BPE, "rb") as a, open(PIECES, "rb") as b:
        tokens = alignment.Tokens(a.read(), b.read())
    rng = random.Random(6)
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 600), rng.randint(0x400, 0x450), rng.randint(0x3040, 0x9FFF), 32, 10])) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 15))) for _ in range(3000)] + [t for t in ODD if t]
    assert [tokens.bpe.encode_ordinary(t) for t in texts] == [e.ids for e in encoders[0].encode_batch(texts, add_special_tokens=False)]


def test_union_find_makes_the_smallest_groups():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        cuts = [np.unique(np.append(rng.integers(1, 60, rng.integers(0, 20)), 60)) for _ in range(2)]
        la, lb = (np.diff(c, prepend=0) for c in cuts)
        i, j, ga, gb = alignment.aligned(np.zeros(len(la)), np.zeros(len(lb)), la, lb)
        common = np.intersect1d(*cuts)
        assert ga.tolist() == np.searchsorted(common, cuts[0]).tolist() and gb.tolist() == np.searchsorted(common, cuts[1]).tolist()
        assert len(i) == sum(max(a - x, b - y) < min(a, b) for a, x in zip(cuts[0], la) for b, y in zip(cuts[1], lb))


def test_no_rows_and_rows_without_tokens(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).orderBy("doc_id").collect()] == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]
