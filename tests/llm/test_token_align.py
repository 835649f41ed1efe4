"""Alignment of whole texts, token by token, against the operator."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillstone.llm.token_align import AlignParams, Aligner, _byte_of_char, align, chunk_row, words_of  # noqa: E402

P = AlignParams(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
WORDS = ["the", "House", "straße", "naïve", "don't", "x", "tokenization", "re-entry", "12345", "...", "日本語", "テスト", "\U0001f600\U0001f468‍\U0001f469", "İstanbul", "ﬁx", "é", "ª²", "Ꭳ", "\U000105c0"]
GAPS = [" ", " ", " ", " ", "  ", "\n", "\t", " \n", "\n ", " ", " 　", "\x1c ", "\x85"]
ODD = [
    None, "", " ", "\n", " x", "x ", "  two  spaces ", "a\tb\x00c", "<s> hi </s> <unk>", "<|endoftext|> end<|endoftext|>", "▁x", "a ▁ b", "<0x41> b", "  x", "x\n y", "the the the",
    "᠎ a", "a​ b", "a ́b", "Hello World 's 'll", "end   ", "� �", "x" * 500, "日" * 300,
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.b)


def texts(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) + r.choice(GAPS) for _ in range(r.randint(1, 40))) for _ in range(n)]


def whole(tokenizers, text):
    """(A ids, B ids, links, groups) of one text, byte by byte; None for texts without tokens."""
    a, b = tokenizers
    if not text:
        return None
    chars = _byte_of_char()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    own_a = [i for i, x in enumerate(bytes_a) for _ in x]
    own_b = [i for i, x in enumerate(bytes_b) for _ in x]
    links = list(dict.fromkeys(zip(own_a, own_b, strict=True)))
    groups, now = [], ([], [])
    for k, (x, y) in enumerate(zip(own_a, own_b, strict=True)):
        if k and x != own_a[k - 1] and y != own_b[k - 1]:
            groups.append(now)
            now = ([], [])
        now[0].append(x), now[1].append(y)
    groups.append(now)
    shown = ";".join("|".join(",".join(str(ids[i]) for i in dict.fromkeys(side)) for ids, side in zip((ids_a, ids_b), g, strict=True)) for g in groups)
    return ids_a, ids_b, [(ids_a[x], ids_b[y]) for x, y in links], groups, hashlib.sha256(shown.encode()).hexdigest()


def brute(tokenizers, docs):
    found = [(d, whole(tokenizers, t)) for d, t in docs]
    counts = Counter(p for _, x in found if x for p in set(x[2]))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return sorted(((d, len(x[0]), len(x[1]), len(x[3]), len(x[2]), sum(counts[p] == most[p[0]] for p in x[2]), sum(counts[p] for p in x[2]), x[4]) if x else (d, 0, 0, 0, 0, 0, 0, "")) for d, x in found)


def got(spark, docs, p=P, parts=3):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(tuple(r) for r in align(frame, p).select("doc_id", *COLUMNS).collect())


def test_rows_are_those_of_whole_texts(spark, tokenizers):
    docs = [*enumerate(ODD + texts(1)), (3, ODD[3]), (60, "the House"), (60, "the House")]
    want = brute(tokenizers, docs)
    assert got(spark, docs) == want
    small = AlignParams(P.a, P.b, chunk_chars=300, slice_chars=40)  # many chunks and slices: nothing changes
    assert got(spark, docs, small) == want
    assert sum(r[1] > 0 for r in want) > 60 and sum(r[1] == 0 for r in want) > 3


def test_the_fast_encoder_has_the_ids_of_the_file(tokenizers):
    aligner, r = Aligner(P), random.Random(5)
    assert aligner.quick is not None
    letters = [chr(c) for c in [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x250), 9, 10, 13, 32]]
    for _ in range(300):
        text = "".join(r.choice(letters[:94] if r.random() < 0.7 else letters) for _ in range(r.randint(1, 60)))
        for w in words_of(text):
            ids = tokenizers[0].encode(" " + w, add_special_tokens=False).ids
            known, place = aligner.align_all([w])
            assert known.counts[0][place[0]] == len(ids) and known.groups[place[0]].count(",") >= 0
            if not (w[0].isspace() or w[-1].isspace()):
                assert aligner.quick.encode_ordinary(" " + w) == ids


def test_a_very_long_text_and_one_long_word(spark, tokenizers):
    docs = [(1, " ".join(f"word{i} and" for i in range(30_000))), (2, "ab1" * 3_000), (3, "and")]
    assert got(spark, docs, AlignParams(P.a, P.b, chunk_chars=1_000)) == brute(tokenizers, docs)


def test_null_ids_empty_tables_and_other_columns(spark, tokenizers):
    frame = spark.createDataFrame([(None, "the House", 1), (None, "the House", 2), (5, None, 3)], "doc_id long, text string, n_a int").withColumn("chunk", F.lit("x"))
    out = align(frame, P).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in out) == [(0, 2, 4), (0, 2, 4), (5, 0, 0)]
    assert align(frame.limit(0), P).count() == 0
    assert align(frame.where("text IS NULL"), P).count() == 1


def test_a_pair_of_all_documents_is_one_row_a_chunk():
    batch = chunk_row(Aligner(P), list(range(100)), ["the House"] * 100)
    assert batch.column("dfs")[0].as_py() == [100] * len(batch.column("pairs")[0].as_py())
