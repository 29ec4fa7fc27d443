"""PII, secrets, token files and SentencePiece against plain versions."""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import pii, secrets
from tessera.llm.pieces import PieceEncoder, encode_pieces
from tessera.llm.queries import END_ID, PIECE_BPE, REGISTRY, WORD_BPE, vocabulary_words
from tessera.llm.token_files import Block, EliasFano, TokenEncoder, pack_block, read_tokens, write_tokens
from tessera.session import shared_folder
from tests.llm.cases import LONG, TEXTS, documents


def plain_pii(text):
    found = {
        "email": re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text),
        "ip": re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text),
        "card": re.finditer(r"[0-9]([\x20-]?[0-9])+", text),
        "phone": re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text),
    }
    out = []
    for kind, matches in found.items():
        for m in matches:
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def plain_secrets(text):
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                    for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [("assign", *m.span()) for m in
           re.finditer(rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+_ 0123456789()%", max_size=60))
def test_base_pii_equals_the_plain_expressions(text):
    assert pii.base_spans(text) == plain_pii(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "ToKen", "API_key", "ſecret", '"', "=", ": ", " ", "abcdef012345",
                                 "AKIA", "ABCDEFGHIJKLMN", "é", "0123456789abcdef", "password"]), max_size=12))
def test_base_secrets_equal_the_plain_expressions(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == plain_secrets(text)


def test_pii_checksums_and_context():
    iban = "pay to account DE89 3704 0044 0532 0130 00 today"
    assert [s[0] for s in pii.find_spans(iban)] == ["iban"]
    assert not pii.find_spans(iban.replace("DE89", "DE88"))
    assert [s[0] for s in pii.find_spans("SSN 219-09-9999")] == ["ssn"]
    assert not pii.find_spans("part 219-09-9999")
    near = pii.find_spans("card 4539 1488 0343 6467")[0]
    far = pii.find_spans("order 4539 1488 0343 6467")[0]
    assert near[:3] == ("card", 5, 24) and near[3] > far[3]


def test_novel_secrets_need_context_and_novelty():
    key = "kQ7xV2mZ9pLr4TnB8wYc3Hs"
    assert [s[0] for s in secrets.find_spans(f"Authorization: Bearer {key}")] == ["novel"]
    assert not secrets.find_spans(f"a word {key}")
    assert not secrets.find_spans(f"{key} is the bearer {key}")  # known from its surroundings
    assert not secrets.find_spans("bearer abcdefghijklmnopqrstuvwxyz0123456789")


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
BASE64 = UPPER + LOWER + DIGITS + "+/"


@pytest.mark.parametrize(
    ("alphabet", "length"),
    [(DIGITS + "ABCDEF", 64), (UPPER + "234567", 128), (LOWER + DIGITS, 200), (BASE64, 400), (BASE64, 800),
     (BASE64, 43), (LOWER, 32), (UPPER + LOWER, 40)],
)
def test_random_keys_of_every_alphabet_are_novel(alphabet, length):
    draw = np.random.default_rng(length)
    for _ in range(20):
        key = "".join(draw.choice(list(alphabet), length))
        for text in (f"Authorization: Bearer {key}\n", f"pwd={key}", f"{key} is the bearer"):
            assert [(k, text[b:e]) for k, b, e, _ in secrets.find_spans(text)] == [("novel", key)]


def test_key_lines_share_their_context():
    draw = np.random.default_rng(3)
    lines = ["".join(draw.choice(list(BASE64), 64)) for _ in range(20)]
    text = "\n".join(["-----BEGIN PRIVATE KEY-----", *lines, "-----END-----"])
    assert [text[b:e] for _, b, e, _ in secrets.find_spans(text)] == lines


def test_words_and_names_are_not_novel():
    known = secrets.identifier_dictionary(vocabulary_words())
    for word in ("responsibilities", "get_user_account_by_identifier", "internationalization-settings",
                 "your_password_here_please", "com/company/project/service/handler", "z" * 24, "-" * 30,
                 "notificationservice", "configurationmanager", "authenticationprovider",
                 "maintenancewindow", "konfigurationsdatei", "databaseconnection", "subscriptionhandler",
                 "temporarydirectory", "customerrelationship", "userAuthenticationProvider"):
        assert not secrets.find_spans(f"the token {word} and others", known), word


def test_the_dictionary_decides():
    known = secrets.identifier_dictionary(vocabulary_words())
    for word in ("notificationservice", "maintenancewindow", "subscriptionhandler"):
        assert secrets.novelty(word, "the token ", "", known) < secrets.NOVELTY
        assert secrets.novelty(word, "the token ", "", b"") >= secrets.NOVELTY
        # Words of the surroundings are known without it.
        assert secrets.novelty(word, f"{word} has the token ", "", b"") < secrets.NOVELTY
    draw = np.random.default_rng(11)
    for alphabet in (BASE64, LOWER, LOWER + DIGITS, UPPER + LOWER):
        for length in (16, 24, 64):
            keys = ["".join(draw.choice(list(alphabet), length)) for _ in range(50)]
            found = sum(secrets.is_random(secrets.novelty(k, "the token ", "", known), length) for k in keys)
            assert found >= (47 if length == 16 else 50)  # sizes are whole bytes: short keys scatter


def test_the_dictionary_is_bounded_and_takes_any_words():
    assert secrets.identifier_dictionary([]) == secrets.IDENTIFIERS.encode()
    many = secrets.identifier_dictionary(f"word{chr(97 + i % 26)}" * (i % 9 + 1) for i in range(10))
    assert many.endswith(secrets.IDENTIFIERS.encode())
    long = secrets.identifier_dictionary("x" * n for n in range(4, 3_000))
    assert len(long) <= secrets.DICTIONARY_BYTES and b" xxxx " in long


def test_repeated_matches_stay_fast():
    assert len(pii.find_spans("a@b.co " * 20_000)) == 20_000
    assert len(pii.find_spans("1" * 200_000)) == 0
    assert len(secrets.find_spans("token " * 20_000)) == 0


def test_span_queries_accept_every_row(spark):
    for operator, plain in ((pii.find_pii, plain_pii), (secrets.find_secrets, plain_secrets)):
        rows = operator(documents(spark)).collect()
        assert len(rows) == len(TEXTS)
        kinds = pii.BASE if operator is pii.find_pii else secrets.BASE
        got = sorted(((r.doc_id or -1), [(s.kind, s.start, s.end) for s in r.spans if s.kind in kinds]) for r in rows)
        assert got == sorted(((i or -1), plain(t or "")) for i, t in TEXTS)
        assert operator(documents(spark, [])).count() == 0


def test_digest_query_equals_plain_version(spark, sf_dir):
    from hashlib import sha256

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for name, plain in (("op1_pii", plain_pii), ("op4_secrets", plain_secrets)):
        for r in REGISTRY[name](spark, sf_dir).collect():
            spans = plain(texts[r.doc_id])
            joined = ",".join(":".join(map(str, s)) for s in spans)
            assert r.base_sha256 == sha256(joined.encode()).hexdigest()
            assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5_000), max_size=700))
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(np.array(gaps, np.int64))
    ef = EliasFano.of(values)
    assert list(ef) == values.tolist()
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    if len(values) > 300:
        bits = 8 * (len(ef.low) + len(ef.high) + 4 * len(ef.hints))
        assert bits <= len(values) * (3 + np.log2(max(2, values[-1] / len(values)))) + 64


def test_block_round_trip():
    ids = np.arange(10, dtype="<u2")
    block = Block(pack_block([3, None, 5], np.array([4, 4, 10]), ids, 77, 2))
    assert (block.doc_ids, block.start, block.n_ids) == ([3, None, 5], 77, 10)
    assert [block.document(i).tolist() for i in range(3)] == [[0, 1, 2, 3], [], [4, 5, 6, 7, 8, 9]]


ODD = ["", " ", "  a", "a ", "▁a", "a▁ b ▁", "\n a\tb", "a　b c", "<s>a</s>", "\x00a", "①", "don't It'LL x",
       "<|endoftext|>a <|startoftext|>", "a.b,c Éx 12 ½ \x1c\x1d", "İ ΣΑΣ ﬁ ß", "x" * 5_000, LONG]


@pytest.mark.parametrize(("name", "by_word", "in_parts"), [(WORD_BPE, True, True), ("byte_bpe_50k.json", False, False)])
def test_words_encode_as_whole_texts(name, by_word, in_parts):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    for bound in (400_000, 3):
        coded = TokenEncoder(path, bound)
        assert (coded.by_word, coded.in_parts) == (by_word, in_parts)
        for text, got in zip(ODD, coded.encode([t.encode() for t in ODD]), strict=True):
            assert np.frombuffer(got, f"<u{coded.width}").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_chunks_encode_as_whole_texts():
    path = public_tokenizers.path(PIECE_BPE)
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    for bound in (400_000, 3):
        pieces = PieceEncoder(path, bound)
        assert pieces.separable
        got = pieces.encode(ODD)
        assert [g.tolist() for g in got] == [whole.encode(t) for t in ODD]
        assert [pieces.decode(g) for g in got] == [whole.decode(whole.encode(t)) for t in ODD]


@pytest.mark.parametrize("block_tokens", [1 << 20, 20])
def test_token_files_round_trip(spark, block_tokens):
    path = public_tokenizers.path(WORD_BPE)
    whole = Tokenizer.from_file(path)
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark), folder, path, END_ID, block_tokens)
    rows = sorted(read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    wanted = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc_id, text) in zip(rows, wanted, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, END_ID]
        assert (row.doc_id, row.start, row.n_tokens, list(row.ids)) == (doc_id, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_of_an_empty_table(spark):
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, []), folder, public_tokenizers.path(WORD_BPE), END_ID)
    assert read_tokens(spark, folder).count() == 0


def test_pieces_accept_every_row(spark):
    path = public_tokenizers.path(PIECE_BPE)
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = encode_pieces(documents(spark), path).collect()
    got = sorted(((r.doc_id or -1), list(r.ids), r.decoded) for r in rows)
    assert got == sorted(((i or -1), whole.encode(t or ""), whole.decode(whole.encode(t or ""))) for i, t in TEXTS)
    assert encode_pieces(documents(spark, []), path).count() == 0
