from __future__ import annotations

import json

from tessera.operators import answers as A
from tests.test_hybrid import NAMES, row, table

STRONG = [
    row(101, 11, title="Socket Timeout Guide", chunk_text="Check the socket.", final_rank=1),
    row(102, 22, chunk_index=4, chunk_text="Follow the path.", final_rank=2, page_number=3,
        section_title="Fix"),
]
CONFIDENT = [row(101, 11, final_rank=1, lexical_rank=1, exact_title_match=True)]
WEAK = [row(101, 11, final_rank=1)]


def q(spark):
    return spark.createDataFrame([(1, "socket timeout")], "query_id long, query_text string")


def answer(spark, rows, response):
    gated = A.gate_evidence(q(spark), table(spark, rows))
    raw = response if isinstance(response, str) or response is None else json.dumps(response)
    responses = spark.createDataFrame([(1, raw)], "query_id long, raw_response string")
    return A.validate_answers(gated, responses).first()


def reply(text, citations, warnings=()):
    return {"answer": text, "citations": citations, "warnings": list(warnings)}


def test_nothing_retrieved_is_refused(spark):
    got = answer(spark, [], None)
    assert got.answer == A.EMPTY_ANSWER and got.warnings == [A.EMPTY_WARNING]
    assert got.weak_retrieval and not got.generator_called
    assert got.citations == [] and got.used_chunks == []


def test_one_weak_chunk_is_refused(spark):
    got = answer(spark, WEAK, reply("x [C1]", ["C1"]))
    assert got.answer == A.SINGLE_ANSWER
    assert got.warnings == [A.LIMITED_WARNING, A.SINGLE_WARNING]
    assert [u.chunk_id for u in got.used_chunks] == [101] and not got.generator_called


def test_one_confident_chunk_needs_an_admission(spark):
    got = answer(
        spark, CONFIDENT, reply("On  Limited\nevidence: timeout [C1].", ["C1"], ["Thin.", " Thin. "])
    )
    assert got.answer == "On  Limited\nevidence: timeout [1]."
    assert got.warnings == [A.LIMITED_WARNING, "Thin."] and got.weak_retrieval
    got = answer(spark, CONFIDENT, reply("It is the timeout [C1].", ["C1"]))
    assert got.failure == A.NOT_ADMITTED and got.answer == A.FAILURE_ANSWER


def test_valid_answer_is_renumbered(spark):
    got = answer(spark, STRONG, reply("See [C2], then [C1] and [C2].", ["[C1]", " C2 "]))
    assert got.answer == "See [1], then [2] and [1]."
    assert [(c.label, c.chunk_id) for c in got.citations] == [("[1]", 102), ("[2]", 101)]
    assert got.citations[0].display == "[1] T — /d/102.md — Fix — page 3 — chunk 4"
    assert got.citations[1].quote == "Check the socket."
    assert got.cited_chunk_count == 2 and got.failure is None


BROKEN = [
    ("not json", A.BAD_JSON),
    (None, A.BAD_JSON),
    ("[1]", A.NOT_AN_OBJECT),
    ("null", A.NOT_AN_OBJECT),
    (reply(" ", []), A.EMPTY_FIELD),
    ({"answer": 5, "citations": []}, A.EMPTY_FIELD),
    ({"citations": []}, A.EMPTY_FIELD),
    (reply("x [C1]", "C1"), A.BAD_LABELS),
    (reply("x [C1]", ["C1", 2]), A.BAD_LABELS),
    (reply("x [C1]", ["C1", None]), A.BAD_LABELS),
    (reply("x [C1]", ["one"]), A.BAD_LABELS),
    (reply("x", ["C1"]), A.UNCITED),
    (reply("x", []), A.UNCITED),
    (reply("x [C1]", ["C1", "C2"]), A.LABEL_MISMATCH),
    ({"answer": "x [C1]"}, A.LABEL_MISMATCH),
    (reply("x [C9]", ["C9"]), A.UNKNOWN_LABEL),
    ({"answer": "x [C1]", "citations": ["C1"], "warnings": "w"}, A.BAD_WARNINGS),
    ({"answer": "x [C1]", "citations": ["C1"], "warnings": [{}]}, A.BAD_WARNINGS),
    ({"answer": "x [C1]", "citations": ["C1"]}, None),
    ({"answer": "x [C1]", "citations": ["C1", "C1"], "warnings": None}, None),
]


def test_first_broken_rule_is_reported(spark):
    """All responses in one batch, one query each."""
    position = NAMES.index("query_id")
    rows = [
        (*r[:position], i, *r[position + 1 :]) for i in range(len(BROKEN)) for r in STRONG
    ]
    questions = spark.createDataFrame(
        [(i, "q") for i in range(len(BROKEN))], "query_id long, query_text string"
    )
    raw = [r if isinstance(r, str) or r is None else json.dumps(r) for r, _ in BROKEN]
    responses = spark.createDataFrame(
        list(enumerate(raw)), "query_id long, raw_response string"
    )
    gated = A.gate_evidence(questions, table(spark, rows))
    got = {r.query_id: r for r in A.validate_answers(gated, responses).collect()}
    for i, (response, failure) in enumerate(BROKEN):
        assert got[i].failure == failure, response
        if failure:
            assert got[i].answer == A.FAILURE_ANSWER and got[i].warnings == [failure]
            assert got[i].citations == [] and got[i].generator_called


def test_prompt_text(spark):
    gated = A.gate_evidence(q(spark), table(spark, STRONG))
    prompt = A.build_prompts(gated).first()
    assert prompt.system_prompt == A.SYSTEM_PROMPT
    assert prompt.user_prompt == "\n".join(
        [
            "Question: socket timeout",
            A.STRONG_INSTRUCTION,
            A.PROMPT_RULES,
            "C1\ntitle: Socket Timeout Guide\npath: /d/101.md\nsection: -\npage: -\nchunk_index: 0",
            "text:\nCheck the socket.\n",
            "C2\ntitle: T\npath: /d/102.md\nsection: Fix\npage: 3\nchunk_index: 4",
            "text:\nFollow the path.",
        ]
    )
    assert A.build_prompts(A.gate_evidence(q(spark), table(spark, WEAK))).count() == 0


def test_context_collapses_and_cuts(spark):
    rows = [row(i, i, final_rank=i) for i in range(1, 8)]
    rows.append(row(9, 1, chunk_text=" text 1 ", final_rank=8))
    context = A.answer_context(table(spark, rows)).orderBy("label").collect()
    assert [(c.label, c.chunk_id) for c in context] == [(f"C{i}", i) for i in range(1, 6)]
    snapshot = A.retrieval_snapshots(q(spark), table(spark, rows)).first()
    assert snapshot.result_count == 8 and len(snapshot.snapshot_id) == 16
    empty = A.retrieval_snapshots(q(spark), table(spark, [])).first()
    assert empty.result_count == 0 and empty.snapshot_id != snapshot.snapshot_id
